"""Engineered features: a plan is a list of FeatureSpec, and execute() adds its columns to a frame."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import stage
from . import ordered
from .frames import with_facts


@dataclass(frozen=True)
class FeatureSpec:
    """kind: transform, binary_op, time_derive, time_delta, window, text_tokens, text_summary."""

    name: str
    kind: str
    base_cols: tuple
    params: dict = field(default_factory=dict)


def log1p(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) > -1, F.log1p(col)))


def sqrt(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) >= 0, F.sqrt(col)))


def zscore_winsorized(df: DataFrame, col: str, out: str, limits: tuple = (0.01, 0.99)) -> DataFrame:
    x = F.col(col).cast("double")
    lo, hi = ordered.quantiles(df, [(x, q) for q in limits])
    held = F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x) if lo is not None else x
    made = with_facts(df.withColumn("_w", held), F.avg("_w").alias("_m"), F.stddev_samp("_w").alias("_s"))
    return made.withColumn(out, (F.col("_w") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_w", "_m", "_s")


def binary(df: DataFrame, a: str, b: str, op: str, out: str) -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    made = {"ratio": F.greatest(x / F.nullif(y, F.lit(0.0)), F.when(x.isNotNull() & y.isNotNull() & (y != 0), F.lit(0.0))), "diff": x - y, "prod": x * y}[op]
    return df.withColumn(out, made)


def calendar(df: DataFrame, time: str, part: str, out: str) -> DataFrame:
    t = F.col(time)
    made = {"dow": F.weekday(t), "hour": F.hour(t), "week": F.weekofyear(t), "month": F.month(t), "quarter": F.quarter(t), "year": F.year(t), "is_weekend": F.weekday(t) >= 5}[part]
    return df.withColumn(out, made)


def _over(df: DataFrame, order_by: list[str], by: list[str] | None, before: int, after: int, columns) -> DataFrame:
    """columns(window) of each group's order, or of the whole one."""
    return df.withColumns(columns(Window.partitionBy(*by).orderBy(*order_by))) if by else ordered.windowed(df, order_by, before, after, columns)


def interarrival(df: DataFrame, time: str, order_by: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Seconds since the row before."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return _over(df, order_by, by, 1, 0, lambda w: {out: (us - F.lag(us).over(w)) / 1e6})


def shifted(df: DataFrame, col: str, order_by: list[str], out: str, by: list[str] | None = None, step: int = 1) -> DataFrame:
    """The value step rows before, or behind where step is negative."""
    return _over(df, order_by, by, max(0, step), max(0, -step), lambda w: {out: F.lag(col, step).over(w) if step > 0 else F.lead(col, -step).over(w)})


def rolling(df: DataFrame, col: str, order_by: list[str], out: str, width: int, least: int, how: str = "mean", by: list[str] | None = None) -> DataFrame:
    def made(w) -> dict:
        last = w.rowsBetween(1 - width, 0)
        return {out: F.when(F.count(col).over(last) >= least, (F.avg if how == "mean" else F.sum)(col).over(last))}

    return _over(df, order_by, by, width - 1, 0, made)


#: What a value still weighs where an average over a whole order begins.
NOTHING = 1e-20


def ewm_mean(df: DataFrame, col: str, order_by: list[str], out: str, by: list[str] | None = None, alpha: float = 0.2) -> DataFrame:
    """y = (1 - alpha) y + alpha x within each group, from its first value on; a missing value leaves y as it is. Rows
    stream through sorted partitions, a batch at a time, with a group's last y handed on. Without groups, a row's y is
    made from the rows before it that weigh more than NOTHING."""
    if not by:
        back = math.ceil(math.log(NOTHING) / math.log(1 - alpha))
        step = lambda y, x: F.when(x.isNull(), y).when(y.isNull(), x).otherwise((1 - alpha) * y + alpha * x)
        values = lambda w: F.collect_list(F.struct(F.col(col).cast("double").alias("x"))).over(w.rowsBetween(-back, 0))
        return ordered.windowed(df, order_by, back, 0, lambda w: {out: F.aggregate(values(w), F.lit(None).cast("double"), lambda y, s: step(y, s["x"]))})
    kind = df.schema.add(out, "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y = None, np.nan
        for frame in frames:
            if frame.empty:
                continue
            keys = list(zip(*(frame[c] for c in by), strict=True))
            got = np.empty(len(frame))
            for i, (key, x) in enumerate(zip(keys, frame[col].astype("float64").to_numpy(), strict=True)):
                if key != last:
                    last, y = key, np.nan
                if x == x:
                    y = x if y != y else (1 - alpha) * y + alpha * x
                got[i] = y
            yield frame.assign(**{out: got})

    return df.repartition(*by).sortWithinPartitions(*by, *order_by).mapInPandas(run, kind)


def autocorrelation(df: DataFrame, col: str, order_by: list[str], lags: tuple = (7, 30)) -> DataFrame:
    """One row: ac_<lag> of each lag."""
    placed = stage(ordered.numbered(df, order_by, "_i").select("_i", F.col(col).cast("double").alias("x")))
    made = None
    for k in lags:  # each value with the one k places before it, met by place
        behind = placed.select((F.col("_i") + k).alias("_i"), F.col("x").alias("y"))
        one = placed.join(behind, "_i").agg(F.corr("x", "y").alias(f"ac_{k}"))
        made = one if made is None else made.crossJoin(one)
    return made


def text_length(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.length(col))


def word_count(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.regexp_count(F.col(col), F.lit(r"[A-Za-z0-9_]+")))


def top_tokens(df: DataFrame, col: str, most: int = 50) -> DataFrame:
    """token, n of the most frequent tokens of three letters or more; ties in their order."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(col)), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def unique_token_ratio(df: DataFrame, col: str, out: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit("[a-z]+"), F.lit(0))
    return df.withColumn(out, F.size(F.array_distinct(words)) / F.nullif(F.size(words), F.lit(0)))


def token_hits(df: DataFrame, col: str, tokens: list[str], out: str) -> DataFrame:
    """How many of the listed tokens a text has."""
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit("[a-z]{3,}"), F.lit(0))
    return df.withColumn(out, F.size(F.array_intersect(words, F.array(*map(F.lit, tokens)))) if tokens else F.lit(0))


def execute(df: DataFrame, plan: list[FeatureSpec], order_by: list[str]) -> DataFrame:
    """df with a column for each spec of the plan; keep_levels leaves other levels of the category out of a window."""
    for s in plan:
        p, base = s.params, list(s.base_cols)
        if s.kind == "transform":
            op = {"log1p": log1p, "sqrt": sqrt, "zscore_wins": zscore_winsorized, "text_len": text_length, "text_word_count": word_count}[p["op"]]
            df = op(df, base[0], s.name)
        elif s.kind == "binary_op":
            df = binary(df, base[0], base[1], p["op"], s.name)
        elif s.kind == "time_derive":
            df = calendar(df, base[0], p["part"], s.name)
        elif s.kind == "time_delta":
            df = interarrival(df, base[0], order_by, s.name, p.get("by"))
        elif s.kind == "text_summary":
            df = unique_token_ratio(df, base[0], s.name)
        elif s.kind == "text_tokens":
            df = token_hits(df, base[0], list(p.get("tokens") or ()), s.name)
        elif s.kind == "window":
            by, op = p.get("by"), p["op"]
            if levels := p.get("keep_levels"):
                df = df.withColumn(f"_{s.name}", F.when(F.col(by[0]).isin(*levels), F.col(base[0])))
                base = [f"_{s.name}"]
            if op in ("lag", "lead"):
                df = shifted(df, base[0], order_by, s.name, by, p.get("step", 1) * (1 if op == "lag" else -1))
            elif op == "ewm_mean":
                df = ewm_mean(df, base[0], order_by, s.name, by, p.get("alpha", 0.2))
            elif op == "autocorr_lags":
                df = df.crossJoin(F.broadcast(autocorrelation(df, base[0], order_by, tuple(p.get("lags", (7, 30)))).select(F.struct("*").alias(s.name))))
            else:
                df = rolling(df, base[0], order_by, s.name, p["window"], p["min_periods"], op.removeprefix("rolling_"), by)
            if levels:
                df = df.drop(f"_{s.name}")
        else:
            raise ValueError(f"no such kind: {s.kind}")
    return df


def ab_difference(df: DataFrame, value: str, treated) -> DataFrame:
    """One row: effect (the arms' difference of means over the standard deviation), n_treated, n_control."""
    x = F.col(value).cast("double")
    made = df.where(F.col(value).isNotNull()).agg(F.avg(F.when(treated, x)).alias("a"), F.avg(F.when(~treated, x)).alias("b"), F.stddev_samp(x).alias("s"), F.count(F.when(treated, 1)).alias("n_treated"), F.count(F.when(~treated, 1)).alias("n_control"))
    return made.select(((F.col("a") - F.col("b")) / F.nullif(F.col("s"), F.lit(0.0))).alias("effect"), "n_treated", "n_control")


def difference_in_differences(df: DataFrame, value: str, treated, time: str) -> DataFrame:
    """One row: did, of the arms' means before and from the median time on."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    made = df.where(F.col(value).isNotNull()).withColumn("_t", us)
    x, late = F.col(value).cast("double"), F.col("_t") >= F.lit(ordered.quantiles(made, [(F.col("_t"), 0.5)])[0])
    m = made.agg(*[F.avg(F.when(c, x)).alias(n) for n, c in (("t1", treated & late), ("t0", treated & ~late), ("c1", ~treated & late), ("c0", ~treated & ~late))])
    return m.select(((F.col("t1") - F.col("t0")) - (F.col("c1") - F.col("c0"))).alias("did"))
