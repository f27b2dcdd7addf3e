"""Periods, frequencies and time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from . import values as V

#: Letters of calendar periods.
CALENDAR = {"D": "day", "W": "week", "M": "month", "MS": "month", "Q": "quarter", "Y": "year", "A": "year", "H": "hour", "T": "minute", "MIN": "minute", "S": "second"}


def parse_any(c: Column) -> Column:
    """A date in any form that robust parsing knows."""
    return V.parse_robust(c)


def to_zone(ts: Column, zone: str, from_zone: str = "UTC") -> Column:
    """The wall clock of zone for a time without a zone, which is that of from_zone."""
    return F.convert_timezone(F.lit(from_zone), F.lit(zone), ts.cast("timestamp_ntz"))


def floor_period(ts: Column, period: str) -> Column:
    unit = CALENDAR.get(period.upper())
    return F.date_trunc(unit, ts).cast("timestamp_ntz") if unit else V.dt_step(ts, period, "floor")


def ceil_period(ts: Column, period: str) -> Column:
    """The start of the next period, or the time itself where it is a start."""
    unit = CALENDAR.get(period.upper())
    if not unit:
        return V.dt_step(ts, period, "ceil")
    low = floor_period(ts, period)
    steps = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR", "week": "INTERVAL 7 DAY"}
    return F.when(low == ts.cast("timestamp_ntz"), low).otherwise(low + F.expr(steps.get(unit, f"INTERVAL 1 {unit.upper()}")))


def gaps(df: DataFrame, time: str) -> DataFrame:
    """gap (microseconds between neighbouring different times), n."""
    us = df.where(F.col(time).isNotNull()).select(F.unix_micros(F.col(time).cast("timestamp")).alias("us")).distinct()
    numbered = ordered.numbered(us, ["us"], "i")
    behind = numbered.select((F.col("i") + 1).alias("i"), F.col("us").alias("last"))
    return numbered.join(behind, "i").groupBy((F.col("us") - F.col("last")).alias("gap")).agg(F.count("*").alias("n"))


def infer_frequency(df: DataFrame, time: str) -> DataFrame:
    """One row: gap, the most frequent one (the smallest of several), its share, and whether all are that long."""
    g = gaps(df, time)
    best = g.agg(F.min(F.struct((-F.col("n")).alias("n"), "gap"))["gap"].alias("gap"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return best.select("gap", (F.col("most") / F.col("all")).alias("share"), (F.col("most") == F.col("all")).alias("regular"))


def is_regular(df: DataFrame, time: str) -> bool:
    """Whether times lie equally far apart; under three different times there is nothing to compare."""
    row = infer_frequency(df, time).first()
    return bool(row and row.regular)
