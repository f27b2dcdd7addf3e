"""What the corpus operators share: tables, staged tables, grouped streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import stage, unstage  # noqa: F401

#: Bytes of rows up to which a side of a join is broadcast; its rows are counted first.
BROADCAST_BYTES = 8 << 20
#: Bytes of a value that a row is taken to have, besides ROW_BYTES of its own; texts are held to be short.
WIDTHS, ROW_BYTES = {"long": 8, "bigint": 8, "int": 8, "double": 8, "boolean": 8, "string": 40}, 16


#: Rows of whole texts that a Python worker gets at once, where the session leaves that at Spark's default.
BATCH_ROWS = 1500


def light(spark: SparkSession) -> SparkSession:
    """Keeps batches of whole texts small, so that workers beside an executor's heap stay so too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return light(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_rows(df: DataFrame) -> int:
    """Rows of df's columns that BROADCAST_BYTES hold."""
    return BROADCAST_BYTES // (ROW_BYTES + sum(WIDTHS.get(kind, 64) for _, kind in df.dtypes))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows fit (a staged table: the count reads footers only); else joins shuffle."""
    return F.broadcast(df) if df.count() <= broadcast_rows(df) else df


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """fn over the rows of each key, one group in memory at a time; cheaper than applyInPandas for many small groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        held = 0
        for frame in frames:
            if frame.empty:
                continue
            change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            change[0] = bool(rest) and tuple(rest[-1][keys].iloc[-1]) != tuple(frame[keys].iloc[0])
            cuts = [i for i in change.nonzero()[0]]
            last = 0
            for cut in cuts:
                rest.append(frame.iloc[last:cut])
                whole = pd.concat(rest) if len(rest) > 1 else rest[0]
                rest, last = [], cut
                if len(whole) and (made := fn(whole)) is not None and len(made):
                    out.append(made)
                    held += len(made)
                    if held >= 5000:
                        yield pd.concat(out)
                        out, held = [], 0
            rest.append(frame.iloc[last:])
        if rest and len(whole := pd.concat(rest)) and (made := fn(whole)) is not None and len(made):
            out.append(made)
        if out:
            yield pd.concat(out)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
