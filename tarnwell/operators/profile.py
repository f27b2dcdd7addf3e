"""Facts of columns: one wide aggregate for all, distinct values in one more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, FractionalType, IntegralType, TimestampNTZType, TimestampType

from ..functions import values as V
from . import ordered

#: Spellings of booleans that profiles count.
BOOL_TOKENS = ("true", "false", "t", "f", "y", "n", "yes", "no", "1", "0")


def tag(kind: DataType) -> str:
    """datetime, int, float, bool or string."""
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    if isinstance(kind, IntegralType):
        return "int"
    if isinstance(kind, FractionalType):
        return "float"
    return "bool" if isinstance(kind, BooleanType) else "string"


def bool_token_ratio(c: Column) -> Column:
    """Of the non-null values, those that spell a boolean."""
    return F.coalesce(F.avg(F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin(*BOOL_TOKENS).cast("double"))), F.lit(0.0))


def numeric_like_ratio(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), ",", "")
    return F.coalesce(F.avg(F.when(c.isNotNull(), V.number(s).isNotNull().cast("double"))), F.lit(0.0))


def datetime_parse_ratio(c: Column, formats: tuple = V.DATE_FORMATS) -> Column:
    return F.coalesce(F.avg(F.when(c.isNotNull(), V.parse_datetime(c, formats).isNotNull().cast("double"))), F.lit(0.0))


def _facts_of(df: DataFrame, c: str, formats: tuple, only: set | None = None) -> dict[str, Column]:
    x, kind = F.col(f"`{c}`"), tag(df.schema[c].dataType)
    out = {"non_null": F.count(x)}
    if kind == "string":
        x = x.cast("string")
        out |= {"avg_len": F.avg(F.length(x)), "bool_token_ratio": bool_token_ratio(x), "numeric_like_ratio": numeric_like_ratio(x), "datetime_parse_ratio": datetime_parse_ratio(x, formats)}
    elif kind in ("int", "float"):
        d = x.cast("double")
        d = F.when(~F.isnan(d), d) if kind == "float" else d
        out |= {"non_null": F.count(d), "mean": F.avg(d), "std": F.stddev_samp(d), "min": F.min(d), "max": F.max(d), "bool_token_ratio": F.coalesce(F.avg(d.isin(0.0, 1.0).cast("double")), F.lit(0.0))}
    return {n: a for n, a in out.items() if only is None or n == "non_null" or n in only}


def facts(df: DataFrame, columns: list[str] | None = None, formats: tuple = V.DATE_FORMATS, distinct: bool = True, quartiles: bool = True, only: set | None = None) -> dict[str, dict]:
    """Facts by column, on the driver: they are numbers, a few dozen a column. Without distinct, those of distinct
    values are left out, and so is their shuffle; without quartiles the interquartile range. only: names of facts, and no
    others are made but the counts that shares of missing values take."""
    cols = columns if columns is not None else df.columns
    if not cols:
        return {}
    wanted = [(c, n, a) for c in cols for n, a in _facts_of(df, c, formats, only).items()]
    row = df.agg(F.count("*").alias("rows"), *[a.alias(f"f{i}") for i, (_, _, a) in enumerate(wanted)]).first()
    numbers = [c for c in cols if tag(df.schema[c].dataType) in ("int", "float")] if quartiles else []
    q = ordered.quantiles(df, [(F.col(f"`{c}`"), s) for c in numbers for s in (0.25, 0.75)])
    iqr = {c: {"iqr": q[2 * i + 1] - q[2 * i] if q[2 * i] is not None else None} for i, c in enumerate(numbers)}
    of = {c: {n: row[f"f{i}"] for i, (k, n, _) in enumerate(wanted) if k == c} | iqr.get(c, {}) for c in cols}
    if only is not None:
        counted = {cols[r.c]: r.n for r in distinct_counts(df, cols).collect()} if distinct else {}
        shares = {"rows": row["rows"], "type": None}
        out = {}
        for c in cols:
            share = of[c]["non_null"] / row["rows"] if row["rows"] else 0.0
            unique = {"nunique": counted.get(c, 0), "cardinality": counted.get(c, 0), "unique_ratio": counted.get(c, 0) / row["rows"] if row["rows"] else 0.0} if distinct else {}
            out[c] = shares | of[c] | unique | {"type": tag(df.schema[c].dataType), "missing_pct": 1 - share if row["rows"] else 0.0, "non_null_ratio": share}
        return out
    if not distinct:
        return {c: _made(c, df, row, of[c]) for c in cols}
    counted = {cols[r.c]: r.n for r in distinct_counts(df, cols).collect()}
    out = {}
    for c in cols:
        own = _made(c, df, row, of[c])
        unique = counted.get(c, 0)
        out[c] = own | {"nunique": unique, "cardinality": unique, "unique_ratio": unique / row["rows"] if row["rows"] else 0.0}
    return out


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """c (place in cols), n: distinct non-null values, most: rows of the most frequent one, of all columns in one aggregate, by
    128 bits of hash each."""
    x = lambda c: F.col(f"`{c}`") if not df.schema[c].dataType.simpleString().startswith("map") else F.to_json(F.col(f"`{c}`"))
    marks = [F.when(x(c).isNotNull(), F.struct(F.lit(i).alias("c"), F.xxhash64(x(c)).alias("h"), F.xxhash64(x(c), F.lit(1)).alias("g"))) for i, c in enumerate(cols)]
    return df.select(F.explode(F.array(*marks)).alias("s")).where("s IS NOT NULL").select("s.*").groupBy("c", "h", "g").agg(F.count("*").alias("rows")).groupBy("c").agg(F.count("*").alias("n"), F.max("rows").alias("most"))


def _made(c: str, df: DataFrame, row, own: dict) -> dict:
    n = row["rows"]
    share = own["non_null"] / n if n else 0.0
    none = dict.fromkeys(("avg_len", "mean", "std", "iqr", "min", "max", "numeric_like_ratio", "datetime_parse_ratio"))
    return {"type": tag(df.schema[c].dataType), "rows": n, "missing_pct": 1 - share if n else 0.0, "non_null_ratio": share, "bool_token_ratio": 0.0, **none, **own}


FACT_COLUMNS = ("missing_pct", "nunique", "unique_ratio", "avg_len", "mean", "std", "iqr", "min", "max")


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the share of rows that have all of the columns; of columns that aren't there nothing is asked."""
    have = [F.col(f"`{c}`").isNotNull() for c in cols if c in df.columns]
    if not have:
        return df.agg(F.lit(0.0).alias("coverage"))
    return df.agg(F.coalesce(F.avg(reduce(lambda a, b: a & b, have).cast("double")), F.lit(0.0)).alias("coverage"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Facts as rows: column_name, type and FACT_COLUMNS."""
    made = facts(df, columns)
    rows = [(c, f["type"], *(None if f[k] is None else float(f[k]) if k != "nunique" else int(f[k]) for k in FACT_COLUMNS)) for c, f in made.items()]
    shape = ", ".join(f"{k} {'long' if k == 'nunique' else 'double'}" for k in FACT_COLUMNS)
    return df.sparkSession.createDataFrame(rows, f"column_name string, type string, {shape}")


def is_monotonic(df: DataFrame, col: str, order_by: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (or one a group): whether values never fall along the order."""
    w = Window.partitionBy(*(by or [])).orderBy(*order_by)
    made = df.where(F.col(col).isNotNull()).withColumn("_d", F.col(col) - F.lag(col).over(w))
    return made.groupBy(*(by or [])).agg(F.coalesce(F.min("_d") >= 0, F.lit(True)).alias("is_monotonic"))
