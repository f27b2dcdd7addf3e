"""The data of charts: each function shapes a frame into the rows that a chart draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as order
from .frames import with_facts


def _check(df: DataFrame, *cols: str) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")


def ordered(df: DataFrame, time: str, *cols: str) -> DataFrame:
    """line, column, area, candlestick, fan, connected scatter, seismogram: the columns, for rows with a time."""
    _check(df, time, *cols)
    return df.select(time, *cols).where(F.col(time).isNotNull())


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int") + 1, F.lit(bins))).otherwise(F.lit(1))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins, the last closed) and n."""
    _check(df, col)
    made = with_facts(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x")), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return made.groupBy(_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def frequency_polygon(df: DataFrame, col: str, group: str, bins: int = 30) -> DataFrame:
    """group, bin, n, share of the group, with the same edges for all groups."""
    made = with_facts(df.select(F.col(group).alias("grp"), F.col(col).cast("double").alias("x")).dropna(), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = made.groupBy("grp", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def xy_heatmap(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    _check(df, x, y)
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    made = with_facts(rows, *[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return made.groupBy(*[_bin(F.col(c), F.col(f"{c}lo"), F.col(f"{c}hi"), bins).alias(f"{c}_bin") for c in "xy"]).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """Distinct values and the share of rows up to each: counts first, so that order is made of distinct values only."""
    by = [group] if group else []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if group:
        w = Window.partitionBy(group)
        return counts.select(group, "value", (F.sum("n").over(w.orderBy("value")) / F.sum("n").over(w)).alias("share"))
    return with_facts(order.running(counts, ["value"], F.col("n"), "to"), F.sum("n").alias("all")).select("value", (F.col("to") / F.col("all")).alias("share"))


def box(df: DataFrame, col: str, group: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the number of outliers."""
    x = F.col(col).cast("double")
    q = order.grouped_quantiles(df, group, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    met = df.dropna(subset=[col, group]).join(q, group)
    inside = x.between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return met.groupBy(F.col(group).alias("grp"), "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))


def calendar_heatmap(df: DataFrame, time: str, metric: str) -> DataFrame:
    """week (from the first week's Monday), weekday (Monday 0), value by day."""
    days = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.sum(metric).alias("value"))
    made = with_facts(days, F.min("day").alias("first"))
    return made.select(F.floor(F.datediff("day", F.to_date(F.date_trunc("week", "first"))) / 7).cast("long").alias("week"), F.weekday("day").alias("weekday"), "value")


def streamgraph(df: DataFrame, time: Column, group: str, metric: str) -> DataFrame:
    """time, grp, value, and the band's lower and upper bound around the middle."""
    made = df.groupBy(time.alias("time"), F.col(group).alias("grp")).agg(F.sum(metric).alias("value"))
    w = Window.partitionBy("time")
    upper = F.sum("value").over(w.orderBy("grp")) - F.sum("value").over(w) / 2
    return made.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("value"))


def slope(df: DataFrame, entity: str, time: str, metric: str, tie: str) -> DataFrame:
    """An entity's first and last value."""
    key = F.struct(time, tie)
    return df.groupBy(F.col(entity).alias("entity")).agg(F.min_by(metric, key).alias("first_value"), F.max_by(metric, key).alias("last_value"), F.count("*").alias("points"))


def bump(df: DataFrame, time: Column, entity: str, metric: str, most: int = 10) -> DataFrame:
    """Ranks by time of the entities that are most often among the first."""
    sums = df.groupBy(time.alias("time"), F.col(entity).alias("entity")).agg(F.sum(metric).alias("value"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("time").orderBy(F.desc("value"), "entity")))
    often = ranked.where(F.col("rank") <= most).groupBy("entity").agg(F.count("*").alias("often")).orderBy(F.desc("often"), "entity").limit(most)
    return ranked.join(F.broadcast(often.select("entity")), "entity", "left_semi").select("time", "entity", "value", "rank")


def top_and_other(df: DataFrame, cat: str, metric: str, most: int = 6) -> DataFrame:
    """pie, donut: the largest and, if there are more than most, the rest as Other."""
    sums = df.groupBy(F.col(cat).alias("cat")).agg(F.sum(metric).alias("value"))
    named = sums.orderBy(F.desc("value"), "cat").limit(most - 1).select(F.col("cat").alias("c"), F.lit(True).alias("named"))
    met = with_facts(sums, F.count("*").alias("n")).join(F.broadcast(named), F.col("cat").eqNullSafe(F.col("c")), "left")
    name = F.when((F.col("n") > most) & F.col("named").isNull(), F.lit("Other")).otherwise(F.col("cat"))
    return met.groupBy(name.alias("cat")).agg(F.sum("value").alias("value"))


def diverging(df: DataFrame, cat: str, metric: str) -> DataFrame:
    """Means less their mean."""
    means = df.groupBy(F.col(cat).alias("cat")).agg(F.avg(metric).alias("value"))
    return with_facts(means, F.avg("value").alias("m")).select("cat", "value", (F.col("value") - F.col("m")).alias("deviation"))


def spine(df: DataFrame, cat: str, positive: Column) -> DataFrame:
    """Shares of rows for and against, to either side of 0."""
    return df.groupBy(F.col(cat).alias("cat")).agg(F.avg(positive.cast("int")).alias("up")).select("cat", (100 * F.col("up")).alias("positive"), (-100 * (1 - F.col("up"))).alias("negative"))


def waterfall(df: DataFrame, step: Column, metric: str) -> DataFrame:
    """Each step's change, and the level after it."""
    sums = df.groupBy(step.alias("step")).agg(F.sum(metric).alias("change"))
    return order.running(sums, ["step"], F.col("change"), "level")


def sankey(df: DataFrame, source: str, target: str, metric: str) -> DataFrame:
    return df.dropna(subset=[source, target]).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.sum(metric).alias("value"))


def nodes(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, index in order of names, degree."""
    ends = edges.select(F.explode(F.array(F.col(source).cast("string"), F.col(target).cast("string"))).alias("node"))
    return order.numbered(ends.groupBy("node").agg(F.count("*").alias("degree")), ["node"], "index").withColumn("index", F.col("index") - 1)


def first_last_pivot(df: DataFrame, time: Column, entity: str, metric: str) -> DataFrame:
    """ranking slope: the mean of the earliest and of the latest time."""
    rows = with_facts(df.select(time.alias("t"), F.col(entity).alias("entity"), F.col(metric).alias("x")), F.min("t").alias("lo"), F.max("t").alias("hi"))
    return rows.groupBy("entity").agg(F.avg(F.when(F.col("t") == F.col("lo"), F.col("x"))).alias("earliest"), F.avg(F.when(F.col("t") == F.col("hi"), F.col("x"))).alias("latest"))


def pyramid(df: DataFrame, cat: Column, side: Column) -> DataFrame:
    """population pyramid: shares of all rows, one side negative."""
    n = df.groupBy(cat.alias("cat")).agg(F.count(F.when(side, 1)).alias("r"), F.count(F.when(~side, 1)).alias("l"))
    return with_facts(n, F.sum(F.col("r") + F.col("l")).alias("total")).select("cat", (100 * F.col("r") / F.col("total")).alias("right"), (-100 * F.col("l") / F.col("total")).alias("left"))


def scaled(df: DataFrame, cat: str, metric: str) -> DataFrame:
    """proportional symbols: areas that go with the value."""
    sums = df.groupBy(F.col(cat).alias("cat")).agg(F.sum(metric).alias("value"))
    return with_facts(sums, F.max("value").alias("most")).select("cat", "value", F.sqrt(F.col("value") / F.col("most")).alias("size"))


def top(df: DataFrame, cat: str, metric: str, most: int = 10) -> DataFrame:
    """ordered bar and column, lollipop: the largest sums."""
    return df.groupBy(F.col(cat).alias("cat")).agg(F.sum(metric).alias("value")).orderBy(F.desc("value"), "cat").limit(most)


def icon_grid(df: DataFrame, cat: str, metric: str, cells: int = 100) -> DataFrame:
    """gridplot, isotype: cells of a grid by share."""
    sums = df.groupBy(F.col(cat).alias("cat")).agg(F.sum(metric).alias("value"))
    return with_facts(sums, F.sum("value").alias("total")).select("cat", "value", F.round(F.col("value") / F.col("total") * cells).cast("long").alias("cells"))


def venn(df: DataFrame, key: str, *sets: Column) -> DataFrame:
    """One row a combination of sets that a key is in: the names' mask and the number of keys."""
    per = df.groupBy(key).agg(*[F.max(s.cast("int")).alias(f"s{i}") for i, s in enumerate(sets)])
    mask = F.concat(*[F.col(f"s{i}").cast("string") for i in range(len(sets))])
    return per.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))


def great_circle(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 16) -> DataFrame:
    """flow map: points along the great circle between two places, as step, lat, lon beside the row's columns."""
    a, b = F.radians(lat1), F.radians(lat2)
    l1, l2 = F.radians(lon1), F.radians(lon2)
    d = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(l2 - l1))))
    rows = df.withColumn("_d", d).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t, s = F.col("step") / steps, F.sin("_d")
    p = F.when(s > 0, F.sin((1 - t) * F.col("_d")) / s).otherwise(1 - t)
    q = F.when(s > 0, F.sin(t * F.col("_d")) / s).otherwise(t)
    x = p * F.cos(a) * F.cos(l1) + q * F.cos(b) * F.cos(l2)
    y = p * F.cos(a) * F.sin(l1) + q * F.cos(b) * F.sin(l2)
    z = p * F.sin(a) + q * F.sin(b)
    return rows.withColumn("lat", F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).withColumn("lon", F.degrees(F.atan2(y, x))).drop("_d")


def seats(df: DataFrame, cat: str, metric: str, total: int = 100) -> DataFrame:
    """hemicycle: a row a seat, largest remainder first."""
    made = icon_grid(df, cat, metric, total).where("cells > 0")
    return made.select("cat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cells"))).alias("seat"))
