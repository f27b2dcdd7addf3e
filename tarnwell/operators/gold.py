"""Analytical components: one small table a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered, stats
from .frames import with_facts


def kpi(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias("value")).select(F.lit(metric).alias("metric_name"), "value")


def trend(df: DataFrame, time: str, metric: str) -> DataFrame:
    day = F.date_trunc("day", time).cast("timestamp_ntz")
    return df.where(F.col(time).isNotNull()).groupBy(day.alias("time")).agg(F.avg(metric).alias("value"))


def correlation_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()


def by_category(df: DataFrame, cat: str, metric: str) -> DataFrame:
    return df.dropna(subset=[cat, metric]).groupBy(F.col(cat).alias("cat")).agg(F.avg(metric).alias("mean"), F.count("*").alias("count"))


def ranking(df: DataFrame, cat: str, metric: str | None = None) -> DataFrame:
    made = df.where(F.col(cat).isNotNull()).groupBy(F.col(cat).alias("cat"))
    return made.agg(F.count("*").alias("count")) if metric is None else made.agg(F.sum(metric).alias("total"))


def part_to_whole(df: DataFrame, cat: str, metric: str | None = None) -> DataFrame:
    made = ranking(df, cat, metric)
    x = F.col("count" if metric is None else "total")
    return with_facts(made, F.sum(x).alias("_t")).withColumn("pct_total", F.when(F.col("_t") != 0, x / F.col("_t")).otherwise(0.0)).drop("_t")


def distribution(df: DataFrame, metric: str) -> DataFrame:
    return df.select(F.col(metric).alias("value")).dropna()


def deviation(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Row by row; facts come from one aggregate, not from a window over the whole."""
    made = with_facts(df.select(F.col(key).alias("key"), F.col(metric).cast("double").alias("value")).where("value IS NOT NULL"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return made.select("key", "value", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("z"))


def deviations(df: DataFrame, metric: str, order_by: list[str] | None = None) -> DataFrame:
    """index, value, z: the rows by their place in the order, or by a number that is unique but tells nothing."""
    rows = df.where(F.col(metric).isNotNull())
    rows = ordered.numbered(rows, order_by, "index").withColumn("index", F.col("index") - 1) if order_by else rows.withColumn("index", F.monotonically_increasing_id())
    return deviation(rows, "index", metric).withColumnRenamed("key", "index")


def cohort(df: DataFrame, entity: str, time: str) -> DataFrame:
    return stats.cohorts(df, entity, time)


def day_of_week(df: DataFrame, time: str, metric: str) -> DataFrame:
    return df.groupBy(F.date_format(time, "EEEE").alias("day_of_week")).agg(F.sum(metric).alias("total"))


def hour_of_day(df: DataFrame, time: str, metric: str) -> DataFrame:
    return df.groupBy(F.hour(time).cast("string").alias("hour_of_day")).agg(F.sum(metric).alias("total"))


def rate(df: DataFrame, num: str, den: str, key: str) -> DataFrame:
    """num over den, 0 for den as missing, not under 0."""
    x = F.col(num) / F.nullif(F.col(den), F.lit(0))
    return df.select(F.col(key).alias("key"), F.when(x < 0, 0.0).otherwise(x).alias("rate"))
