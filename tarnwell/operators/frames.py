"""Cleaning that needs more than the value: facts of the column, its order, or its other values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import epoch, epoch_unit, fraction_to_percent, percent_to_fraction
from . import ordered
from .profile import distinct_counts


def with_facts(df: DataFrame, *facts: Column, by: list[str] | None = None) -> DataFrame:
    """df with aggregates of itself: one row, or one a group, joined back."""
    if by:
        return df.join(df.groupBy(*by).agg(*facts), by, "left")
    return df.crossJoin(F.broadcast(df.agg(*facts)))


def impute(df: DataFrame, col: str, method: str, order_by: list[str] | None = None, by: list[str] | None = None, out: str | None = None, value=None, time_col: str | None = None, limit_direction: str = "both") -> DataFrame:
    """Missing values by mean, median, mode, constant, or in an explicit order by ffill, bfill or interpolate: linear in
    the row's place, or in time_col, and held at the ends, or at the one that limit_direction (both, forward, backward)
    says. mode's ties go to the smallest. An order of the whole frame is dealt out in slices."""
    out = out or col
    x = F.col(col)
    if method == "median" and not by:
        return df.withColumn(out, F.coalesce(x.cast("double"), F.lit(ordered.quantiles(df, [(x, 0.5)])[0])))
    if method == "median":
        facts = ordered.grouped_quantiles(df.withColumn("_by", F.xxhash64(*by)), "_by", col, {"_fact": 0.5})
        return df.withColumn("_by", F.xxhash64(*by)).join(facts, "_by", "left").withColumn(out, F.coalesce(x.cast("double"), "_fact")).drop("_by", "_fact")
    if method == "mean":
        return with_facts(df, F.avg(x).alias("_fact"), by=by).withColumn(out, F.coalesce(x.cast("double"), "_fact")).drop("_fact")
    if method == "mode":
        counts = df.where(x.isNotNull()).groupBy(col).count()
        best = counts.agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(col).alias("v")))["v"].alias("_fact"))
        return df.crossJoin(F.broadcast(best)).withColumn(out, F.coalesce(x, "_fact")).drop("_fact")
    if method == "constant":
        return df.withColumn(out, F.coalesce(x, F.lit(value)))
    if not order_by:
        raise ValueError(f"{method} needs an order")
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"no such method: {method}")
    if not by and not df.where(x.isNull()).agg(F.count("*")).first()[0]:  # no gap: no order is needed
        return df.withColumn(out, x.cast("double") if method == "interpolate" else x)
    at = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double") if time_col else None
    number = "_at" if method == "interpolate" and at is None and not by else None  # as the order is dealt out
    if method == "interpolate":
        if not number:
            df = df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)).cast("double") if at is None else at)
        known = F.when(x.isNotNull(), F.struct(F.col("_at").cast("double").alias("t"), x.cast("double").alias("v")))
    else:
        known = x
    if by:
        df = ordered.around(df.withColumn("_k", known), by, order_by, "_k", "_a", "_b").drop("_k")
    else:
        df = ordered.neighbours(df, order_by, known, "_a", "_b", number)
    if method != "interpolate":
        return df.withColumn(out, F.col("_a" if method == "ffill" else "_b")).drop("_a", "_b")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_at") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    ends = {"both": ["_a.v", "_b.v"], "forward": ["_a.v"], "backward": ["_b.v"]}[limit_direction]  # held at the ends
    inner = F.coalesce(x.cast("double"), line, *ends) if limit_direction == "both" else F.coalesce(x.cast("double"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line), *ends)
    return df.withColumn(out, inner).drop("_at", "_a", "_b")


def outlier_bounds(df: DataFrame, cols: list[str], method: str = "zscore", z: float = 3.0, k: float = 1.5, limits: tuple | None = None) -> dict[str, dict]:
    """What the masks need, of all columns together: odd under lo or over hi (None: none are), and ends, the quantiles of
    limits. The distance is from the median over the median deviation, or where that is 0 from the mean over the standard
    deviation, of 3 values at least; or Tukey's fences, of 4 at least."""
    if not cols:
        return {}
    xs = {c: F.col(f"`{c}`").cast("double") for c in cols}
    row = df.agg(*[f(xs[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]).first()
    shares = (0.25, 0.75) if method == "iqr" else (0.5,)
    got = ordered.quantiles(df, [(xs[c], q) for c in cols for q in (*shares, *(limits or ()))])
    per = len(shares) + len(limits or ())
    found = {c: got[i * per : (i + 1) * per] for i, c in enumerate(cols)}
    mads = {} if method == "iqr" else dict(zip(cols, ordered.quantiles(df, [(F.abs(xs[c] - F.lit(found[c][0])), 0.5) for c in cols]), strict=True))
    out = {}
    for i, c in enumerate(cols):
        n, lo, hi = row[f"n{i}"], None, None
        if method == "iqr" and n >= 4 and found[c][1] > found[c][0]:
            lo, hi = found[c][0] - k * (found[c][1] - found[c][0]), found[c][1] + k * (found[c][1] - found[c][0])
        elif method != "iqr" and n >= 3:
            middle, unit = (found[c][0], mads[c] / 0.6745) if mads[c] else (row[f"m{i}"], row[f"s{i}"])
            lo, hi = (middle - z * unit, middle + z * unit) if unit else (None, None)
        out[c] = {"lo": lo, "hi": hi, "ends": found[c][len(shares) :]}
    return out


def _odd(x: Column, bounds: dict) -> Column:
    return F.lit(False) if bounds["lo"] is None else F.coalesce((x < bounds["lo"]) | (x > bounds["hi"]), F.lit(False))


def outlier_counts(df: DataFrame, cols: list[str], method: str = "zscore", z: float = 3.0, k: float = 1.5) -> dict[str, int]:
    """How many outliers each column has, all in one aggregate after their bounds are known."""
    bounds = outlier_bounds(df, cols, method, z, k)
    row = df.agg(*[F.count(F.when(_odd(F.col(f"`{c}`").cast("double"), bounds[c]), 1)).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else {}
    return {c: row[f"n{i}"] for i, c in enumerate(cols)}


def outliers(df: DataFrame, col: str, method: str = "zscore", z: float = 3.0, k: float = 1.5, handle: str = "flag", limits: tuple = (0.01, 0.99), out: str | None = None) -> DataFrame:
    """Outliers as outlier_bounds says. handle flag: a boolean column <col>_outlier; drop: null; winsorize: to the
    limits' quantiles; others change nothing."""
    x = F.col(f"`{col}`").cast("double")
    bounds = outlier_bounds(df, [col], method, z, k, limits if handle == "winsorize" else None)[col]
    if handle == "flag":
        return df.withColumn(out or f"{col}_outlier", _odd(x, bounds))
    if handle == "drop":
        return df.withColumn(out or col, F.when(~_odd(x, bounds), x))
    if handle == "winsorize" and bounds["ends"][0] is not None:
        lo, hi = bounds["ends"]
        return df.withColumn(out or col, F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x))
    return df


def standardize_percent(df: DataFrame, col: str, target: str = "fraction", out: str | None = None) -> DataFrame:
    """Percents in the form of target. A column is in fractions if four in five values are at most 1, or else in
    percents; if that isn't the target, values over 1 are divided by 100, or those up to 1 multiplied."""
    x = F.col(col).cast("double")
    made = with_facts(df, F.avg((x <= 1).cast("double")).alias("_share"))
    fractions = F.col("_share") >= 0.8
    changed = F.when(fractions, x).otherwise(percent_to_fraction(x)) if target != "percent" else F.when(fractions, fraction_to_percent(x)).otherwise(x)
    return made.withColumn(out or col, changed).drop("_share")


def parse_epochs(df: DataFrame, col: str, unit: str | None = None, out: str | None = None) -> DataFrame:
    """Epochs as timestamps, by the unit that the median's size says."""
    if unit:
        return df.withColumn(out or col, epoch(F.col(col), unit))
    size = ordered.quantiles(df, [(F.abs(F.col(col).try_cast("double")), 0.5)])[0]
    return df.withColumn(out or col, epoch(F.col(col), epoch_unit(F.lit(size))))


def rare_categories(df: DataFrame, col: str, least: float = 0.01, other: str = "Other", out: str | None = None) -> DataFrame:
    """Values under that share of the non-null rows become other."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).count()
    rare = with_facts(counts, F.sum("count").alias("_all")).where(F.col("count") / F.col("_all") < least).select("_v", F.lit(True).alias("_rare"))
    return df.join(rare, F.col(col) == F.col("_v"), "left").withColumn(out or col, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col))).drop("_v", "_rare")


#: Words that name no brand.
STOPWORDS = frozenset(
    "inc llc l.l.c corp co company ltd restaurant restaurants store stores the group intl international sa ag gmbh bv plc pte llp l.l.p pc p.c. and & rd st ave blvd dr "
    "hwy ctr ct pl ln suite ste unit us usa".split()
)


def extract_anchor(df: DataFrame, col: str, least: int = 3, digits: bool = False, stopwords: frozenset = STOPWORDS, out: str | None = None) -> DataFrame:
    """The word of each value that is most frequent in the column; ties go to the nearest to the column's most frequent
    word, the longer, the first. Works on distinct values, weighted by their rows."""
    kind = r"\p{L}\p{N}" if digits else r"\p{L}"
    words = F.filter(F.split(F.lower(F.col("_v")), f"[^{kind}]+"), lambda w: (F.length(w) >= least) & ~w.isin(*sorted(stopwords)))
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n")).select("_v", "_n", F.explode(words).alias("_w"))
    often = values.groupBy("_w").agg(F.sum("_n").alias("_f"))
    first = often.agg(F.max(F.struct("_f", F.length("_w").alias("l"), "_w"))["_w"].alias("_top"))
    ranked = values.join(often, "_w").crossJoin(F.broadcast(first))
    best = ranked.groupBy("_v").agg(F.min(F.struct((-F.col("_f")).alias("f"), F.levenshtein("_w", "_top").alias("d"), (-F.length("_w")).alias("l"), F.col("_w").alias("w")))["w"].alias("_best"))
    return df.join(best, F.col(col) == F.col("_v"), "left").withColumn(out or col, F.col("_best")).drop("_v", "_best")


def column_stats(df: DataFrame) -> DataFrame:
    """column_name, rows, non_null, missing_pct, nunique, unique_ratio of each column, in two aggregates."""
    return _stats(df).drop("most")


def _stats(df: DataFrame) -> DataFrame:
    """column_stats with most: the rows of the column's most frequent value."""
    cols = df.columns
    base = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)])
    one = base.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(cols)])).alias("s")).select("s.*", "n")
    names = F.array(*map(F.lit, cols))
    distinct = distinct_counts(df, cols).select(F.get(names, F.col("c")).alias("column_name"), F.col("n").alias("nunique"), "most")
    return one.join(distinct, "column_name", "left").select(
        "column_name", F.col("n").alias("rows"), "non_null", (1 - F.col("non_null") / F.col("n")).alias("missing_pct"),
        F.coalesce("nunique", F.lit(0).cast("long")).alias("nunique"), (F.coalesce("nunique", F.lit(0)) / F.col("n")).alias("unique_ratio"),
        F.coalesce("most", F.lit(0).cast("long")).alias("most"),
    )


def hash_sample(df: DataFrame, share: float, key: list[str], seed: int = 42) -> DataFrame:
    """About that share of the rows, the same ones in every run: those whose key's MD5 is small."""
    limit = format(min(0xFFFFFFFF, max(0, round(share * 0x100000000))), "08x")
    mark = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), 1, 8)
    return df if share >= 1 else df.where(mark < F.lit(limit))


def prune(df: DataFrame, missing: float = 0.9, unique: float = 0.001, keep: tuple = ()) -> tuple[DataFrame, dict[str, str]]:
    """Without sparse and constant-like columns; why each went. A column is constant-like where at most that share of its
    non-null values is another than its most frequent one: the share of distinct values says it only of columns of one
    size, as it falls with the rows."""
    why = {}
    for r in _stats(df).collect():
        if r.column_name not in keep:
            if r.missing_pct >= missing:
                why[r.column_name] = "sparse"
            elif r.non_null - r.most <= unique * r.non_null:
                why[r.column_name] = "constant"
    return df.drop(*why), why


def quarantine(df: DataFrame, known: list[str], prefix: str = "__quarantine__") -> DataFrame:
    """Unknown columns get a prefix, once."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in known and not c.startswith(prefix)})
