"""Statistics as aggregates: one pass each where moments suffice, p-values on the driver from the few numbers left."""

from __future__ import annotations

from itertools import combinations
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues
from . import ordered


def _both(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r, n of every pair, in one aggregate."""
    pairs = list(combinations(cols, 2))
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(rows))


def pearson(df: DataFrame, a: str, b: str) -> dict:
    r = _both(df, a, b).agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).first()
    if r.n < 3 or r.r is None or r.r != r.r:
        return {"r": 0.0, "n": r.n, "p": 1.0}
    return {"r": r.r, "n": r.n, "p": pvalues.pearson_p(r.r, r.n)}


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: eta2, k, n, f of value between groups."""
    x = F.col(value).cast("double")
    per = _both(df, value, group).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ss"))
    all_ = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ssw"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("ssb"))
    msb, msw = F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    f = F.when(F.col("k") < 2, 0.0).when((F.coalesce(msw, F.lit(0.0)) <= 0) & (F.col("ssb") > 0), float("inf")).when(F.coalesce(msw, F.lit(0.0)) <= 0, 0.0).otherwise(msb / msw)
    eta2 = F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce(F.col("ssb") / F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0)), F.lit(0.0)))
    return all_.select(eta2.alias("eta2"), F.col("k"), F.coalesce("n", F.lit(0)).alias("n"), f.alias("f"))


def anova_test(df: DataFrame, value: str, group: str) -> dict:
    r = anova(df, value, group).first().asDict()
    return r | {"p": 0.0 if r["f"] == inf else pvalues.f_sf(r["f"], r["k"] - 1, r["n"] - r["k"]) if r["k"] > 1 else 1.0}


def cramers(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: v, n, dof, chi2 of the contingency of two categories, without continuity correction."""
    cells = _both(df, a, b).groupBy(a, b).agg(F.count("*").alias("o"))
    rows = cells.withColumn("r", F.sum("o").over(Window.partitionBy(a))).withColumn("c", F.sum("o").over(Window.partitionBy(b)))
    one = rows.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    least = F.least("ka", "kb") - 1
    chi2 = F.when(least > 0, F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))).otherwise(0.0)
    v = F.when(least > 0, F.sqrt(chi2 / (F.col("n") * least))).otherwise(0.0)
    return one.select(v.alias("v"), F.coalesce("n", F.lit(0)).alias("n"), F.when(least > 0, (F.col("ka") - 1) * (F.col("kb") - 1)).otherwise(0).alias("dof"), chi2.alias("chi2"))


def cramers_test(df: DataFrame, a: str, b: str) -> dict:
    r = cramers(df, a, b).first().asDict()
    return r | {"p": pvalues.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0}


def trend_slope(df: DataFrame, value: str, order_by: list[str], by: list[str] | None = None) -> DataFrame:
    """slope (against the row's place, over the mean size) and n; under 3 rows the slope is 0."""
    rows = _both(df, value)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))) if by else ordered.numbered(rows, order_by, "_i")
    raw = F.regr_slope(F.col(value), F.col("_i")) / F.nullif(F.avg(F.abs(value)), F.lit(0.0))
    slope = F.when(F.count("*") >= 3, F.coalesce(raw, F.lit(0.0))).otherwise(0.0)
    return rows.groupBy(*(by or [])).agg(slope.alias("slope"), F.count("*").alias("n"))


def concentration(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: gini and hhi of the sums of value by group; negatives aside, nothing to share gives 0."""
    sums = df.groupBy(group).agg(F.sum(value).alias("x")).where("x >= 0")
    ranked = ordered.numbered(sums, ["x", group], "i")
    n, total = F.count("*"), F.sum("x")
    gini = F.when(total > 0, 2 * F.sum(F.col("i") * F.col("x")) / (n * total) - (n + 1) / n).otherwise(0.0)
    hhi = F.when(total > 0, F.sum(F.col("x") * F.col("x")) / (total * total)).otherwise(0.0)
    return ranked.agg(F.coalesce(gini, F.lit(0.0)).alias("gini"), F.coalesce(hhi, F.lit(0.0)).alias("hhi"))


def skew(col: str) -> Column:
    n = F.count(col)
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(col: str) -> Column:
    n = F.count(col)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


def cohorts(df: DataFrame, entity: str, time: str) -> DataFrame:
    """first_seen, age, retained, cohort_size, retention_pct by month of an entity's first row."""
    month = F.date_trunc("month", F.col(time).cast("timestamp"))
    seen = _both(df, entity, time).select(F.col(entity).alias("_e"), month.alias("_m")).distinct()
    born = seen.withColumn("_f", F.min("_m").over(Window.partitionBy("_e")))
    age = (F.year("_m") - F.year("_f")) * 12 + F.month("_m") - F.month("_f")
    kept = born.groupBy(F.col("_f").cast("timestamp_ntz").alias("first_seen"), age.alias("age")).agg(F.count("*").alias("retained"))
    size = F.first("retained").over(Window.partitionBy("first_seen").orderBy("age"))
    return kept.withColumn("cohort_size", size).withColumn("retention_pct", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("retained") / F.col("cohort_size"))))


def welch(df: DataFrame, value: str, arm: Column) -> dict:
    """p of the difference of two arms' means, by the normal distribution; under 3 rows an arm it is 1."""
    x = F.col(value).cast("double")
    r = df.where(F.col(value).isNotNull()).agg(*[f(F.when(cond, x)).alias(f"{n}{k}") for k, cond in (("a", arm), ("b", ~arm)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).first()
    if r.na < 3 or r.nb < 3:
        return {"diff": 0.0, "z": 0.0, "p": 1.0}
    se = (r.va / r.na + r.vb / r.nb) ** 0.5
    z = (r.ma - r.mb) / se if se else inf
    return {"diff": r.ma - r.mb, "z": z, "p": pvalues.z_two_tailed(z)}
