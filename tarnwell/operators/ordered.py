"""Order and quantiles of a whole frame without one task that holds it all.

A frame is dealt out by ranges of its order into slices, which are staged, so that every reader sees the same slices.
What a slice hands on to those behind it, a count, a sum, a last known value, is a row a slice: those few rows are
summed up in order, and each slice goes on from what it is handed. Quantiles narrow the range that holds them until the
values inside are few.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import stage

#: Values among which a quantile is selected exactly in one aggregate.
FEW = 50_000


def sliced(df: DataFrame, order_by: list[str], descending: bool = False) -> DataFrame:
    """df, staged, with _slice and _place: rows of a slice come before those of the next one in the order, and inside a slice
    they are numbered by it from 0. Rows are sorted once, where they are written."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order) if df.columns else df
    cut = stage(spread.withColumn("_row_id", F.monotonically_increasing_id()))
    return cut.withColumns({"_slice": F.shiftright("_row_id", 33).cast("int"), "_place": F.col("_row_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row_id")


def _before(cut: DataFrame, amount: Column) -> DataFrame:
    """cut with _before: the sum of amount over the slices before a row's own."""
    sums = cut.groupBy("_slice").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_slice", F.coalesce(F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(before), "_slice")


def running(df: DataFrame, order_by: list[str], amount: Column, out: str, descending: bool = False) -> DataFrame:
    """df with the sum of amount over the rows up to each one."""
    within = F.sum(amount).over(Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return _before(sliced(df, order_by, descending), amount).withColumn(out, F.col("_before") + within).drop("_slice", "_place", "_before")


def _number(cut: DataFrame, out: str) -> DataFrame:
    return _before(cut, F.lit(1).cast("long")).withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_before")


def numbered(df: DataFrame, order_by: list[str], out: str, descending: bool = False) -> DataFrame:
    """df with each row's place in the order, from 1."""
    return _number(sliced(df, order_by, descending), out).drop("_slice", "_place")


#: Rows of a block of a window over the whole order.
BLOCK = 100_000


def windowed(df: DataFrame, order_by: list[str], before: int, after: int, columns) -> DataFrame:
    """df with columns(window): Columns by name over a window of the whole order that looks at most so many rows back and
    ahead. Blocks of places are windows of their own, each with copies of its neighbours' last and first rows."""
    if max(before, after) >= BLOCK:
        raise ValueError("a window wider than a block")
    at = (F.col("_i") - 1) % BLOCK
    own = F.floor((F.col("_i") - 1) / BLOCK)
    copies = F.array_compact(F.array(own, F.when(at >= BLOCK - before, own + 1) if before else F.lit(None), F.when((at < after) & (own > 0), own - 1) if after else F.lit(None)))
    rows = numbered(df, order_by, "_i").withColumn("_own", own).withColumn("_block", F.explode(copies))
    w = Window.partitionBy("_block").orderBy("_i")
    return rows.withColumns(columns(w)).where("_block = _own").drop("_i", "_own", "_block")


def around(df: DataFrame, by: list[str], order_by: list[str], known: str, before: str, after: str) -> DataFrame:
    """df with the last value of the column known at or before each row of its group, and the first at or after it. What
    comes after is looked up in the reverse order of the rows' numbers: a frame that ends with the group is gone through anew
    for each row, and ties have one order both ways."""
    return _around(df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))), by, known, before, after).drop("_place")


def _around(df: DataFrame, by: list[str], known: str, before: str, after: str) -> DataFrame:
    """around, in the order of _place."""
    last = lambda place: F.last(known, True).over(Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(before, last(F.col("_place"))).withColumn(after, last(F.col("_place").desc()))


def neighbours(df: DataFrame, order_by: list[str], known: Column, before: str, after: str, number: str | None = None) -> DataFrame:
    """df with the last value of known at or before each row, and the first at or after it. number: a column more, each
    row's place in the order from 1, which known may read; it takes no further pass over the order."""
    cut = sliced(df, order_by)
    cut = (_number(cut, number) if number else cut).withColumn("_known", known)
    has = F.col("_known").isNotNull()
    ends = cut.groupBy("_slice").agg(*[f(F.when(has, F.col("_known")), F.when(has, F.col("_place"))).alias(n) for n, f in (("_last", F.max_by), ("_first", F.min_by))])
    over = Window.orderBy("_slice")
    handed = ends.select(
        "_slice", F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_before"),
        F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_from_after"),
    )
    met = _around(cut.join(F.broadcast(handed), "_slice"), ["_slice"], "_known", "_back", "_ahead")
    return met.withColumn(before, F.coalesce("_back", "_from_before")).withColumn(after, F.coalesce("_ahead", "_from_after")).drop("_slice", "_place", "_known", "_from_before", "_from_after", "_back", "_ahead")


def quantiles(df: DataFrame, wanted: list[tuple[Column, float]]) -> list[float | None]:
    """Exact quantiles, between neighbours by a straight line, of columns over all rows; null and NaN are no values.

    Ranges are narrowed by approximate quantiles until FEW values at most lie inside, or they are all the same; then
    one aggregate selects. Its state is bounded whatever the number of rows."""
    if not wanted:
        return []
    xs = [F.when(~F.isnan(x.cast("double")), x.cast("double")) for x, _ in wanted]
    row = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    state = [{"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "below": 0, "inside": row[f"n{i}"], "at": q * (row[f"n{i}"] - 1)} for i, (_, q) in enumerate(wanted)]
    while wide := [i for i, s in enumerate(state) if s["inside"] > FEW and s["lo"] < s["hi"] and "found" not in s]:
        held = {i: F.when(xs[i].between(state[i]["lo"], state[i]["hi"]), xs[i]) for i in wide}
        share = {i: [min(1.0, max(0.0, (r - state[i]["below"]) / state[i]["inside"] + d)) for r, d in ((floor(state[i]["at"]), -0.002), (ceil(state[i]["at"]) + 1, 0.002))] for i in wide}
        ends = df.agg(*[F.percentile_approx(held[i], share[i], 2000).alias(f"e{i}") for i in wide]).first()
        made = df.agg(*[F.count(F.when(c, 1)).alias(f"{n}{i}") for i in wide for n, c in (("b", xs[i] < ends[f"e{i}"][0]), ("w", xs[i].between(*ends[f"e{i}"])))]).first()
        for i in wide:
            s = state[i]
            b, w, (lo, hi) = made[f"b{i}"], made[f"w{i}"], ends[f"e{i}"]
            if b <= floor(s["at"]) and ceil(s["at"]) < b + w and w < s["inside"]:
                s |= {"lo": lo, "hi": hi, "below": b, "inside": w}
            else:  # the approximation missed it, or can't narrow any more: select among what there is
                s["found"] = True
    few = [i for i, s in enumerate(state) if s["inside"] and s["lo"] < s["hi"]]
    picks = [F.percentile(F.when(xs[i].between(state[i]["lo"], state[i]["hi"]), xs[i]), F.lit(min(1.0, (state[i]["at"] - state[i]["below"]) / max(1, state[i]["inside"] - 1)))).alias(f"q{i}") for i in few]
    got = df.agg(*picks).first() if picks else None
    return [None if not s["inside"] else got[f"q{i}"] if i in few else s["lo"] for i, s in enumerate(state)]


def grouped_quantiles(df: DataFrame, by: str, col: str, shares: dict[str, float]) -> DataFrame:
    """by and one exact quantile a name, of each group: from counts of distinct values, ranked by a window that spills,
    so that no value list is held in memory."""
    x = F.col(col).cast("double")
    counts = df.where(F.col(by).isNotNull() & x.isNotNull()).groupBy(F.col(by), x.alias("_x")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    ranked = counts.withColumn("_to", F.sum("_c").over(w.orderBy("_x"))).withColumn("_n", F.sum("_c").over(w))
    at = {n: (F.col("_n") - 1) * F.lit(q) for n, q in shares.items()}
    holds = lambda place: (place >= F.col("_to") - F.col("_c")) & (place < F.col("_to"))
    aggs = [F.max(F.when(holds(f(at[n])), F.col("_x"))).alias(f"_{e}{n}") for n in shares for e, f in (("lo", F.floor), ("hi", F.ceil))]
    made = ranked.groupBy(by).agg(F.max("_n").alias("_n"), *aggs)
    return made.select(by, *[(F.col(f"_lo{n}") + (F.col(f"_hi{n}") - F.col(f"_lo{n}")) * (at[n] - F.floor(at[n]))).alias(n) for n in shares])
