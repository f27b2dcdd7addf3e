"""A messy table for tests and trials: what real files hold wrong, made from row numbers and a seed, so it is the same in
every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = ("Berlin", "Lyon", "Porto", "Graz", "Turin")


def _draw(seed: int, name: str, n: int) -> Column:
    """A number under n, by row and name."""
    return F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(name)), F.lit(n))


def _mixed(seed: int, name: str, *ways: Column) -> Column:
    pick = _draw(seed, name, len(ways))
    out = ways[-1]
    for k, way in enumerate(ways[:-1]):
        out = F.when(pick == k, way).otherwise(out)
    return out


def messy(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """row_id, and as text: amounts with signs and units, dates in three forms, booleans spelt five ways, cities in any
    case with gaps, postal codes short of zeros, percents and fractions, and a column that is nearly empty."""
    base = spark.range(rows).withColumnRenamed("id", "row_id")
    cents = _draw(seed, "amount", 2_000_000).cast("double") / 100 - 2000
    plain = F.format_string("%.2f", cents)
    day = F.date_add(F.lit("2022-01-01").cast("date"), _draw(seed, "day", 900).cast("int"))
    city = F.element_at(F.array(*map(F.lit, CITIES)), (_draw(seed, "city", len(CITIES)) + 1).cast("int"))
    share = _draw(seed, "share", 1001).cast("double") / 10
    return base.select(
        "row_id",
        _mixed(seed, "a", plain, F.concat(F.lit("$"), plain), F.concat(F.lit(" "), plain, F.lit(" ")), F.format_number(cents, 2), F.lit("n/a"), F.lit(None).cast("string")).alias("amount_usd"),
        _mixed(seed, "d", F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "yyyy/MM/dd"), F.lit("")).alias("event_date"),
        _mixed(seed, "b", *map(F.lit, ("Yes", "no", "TRUE", "0", "1", "F"))).alias("is_paid"),
        _mixed(seed, "c", city, F.upper(city), F.concat(F.lit("  "), F.lower(city)), F.lit("-"), F.lit("NULL")).alias("city"),
        F.when(_draw(seed, "z", 20) > 0, _draw(seed, "zip", 99_999).cast("string")).alias("zip_code"),
        _mixed(seed, "s", F.concat(share.cast("string"), F.lit("%")), (share / 100).cast("string")).alias("discount_pct"),
        F.when(_draw(seed, "e", 50) == 0, F.lit("x")).alias("remark"),
    )
