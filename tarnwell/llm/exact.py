"""Exact dedup by composable polynomial fingerprints.

A text is a polynomial over its UTF-8 bytes modulo 2^31 - 1, at four fixed points. Chunks are hashed on their own, in
parallel, and combined by shifting a prefix by the length of what follows: H(ab) = H(a) r^len(b) + H(b). Texts of equal
length and fingerprint are then compared chunk by chunk with the row that stays, so that a collision never drops a text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import broadcast_rows, small, stage, table, unstage

P = (1 << 31) - 1
BASES = (1_103_515_245, 69_621_743, 1_812_433_253, 214_013_531)
CHUNK = 1024
_R = np.array([b % P for b in BASES], np.int64)
#: Bytes hashed at once; a longer text is hashed in segments that are combined.
SEGMENT = 1 << 22
#: Bytes of a chunk in the comparison.
COMPARE = 1 << 16


def _pow(e: int) -> np.ndarray:
    return np.array([pow(int(r), e, P) for r in _R], np.int64)


_WITHIN = np.array([_pow(CHUNK - 1 - k) for k in range(CHUNK)], np.float64)
_shift = [np.ones(4, np.int64)]


def _shifts(n: int) -> np.ndarray:
    """r^(CHUNK k) for k < n."""
    step = _pow(CHUNK)
    while len(_shift) < n:
        _shift.append(_shift[-1] * step % P)
    return np.array(_shift[:n])


def combine(a: np.ndarray, b: np.ndarray, b_bytes: int) -> np.ndarray:
    """The fingerprint of a text from those of its two parts and the length of the second."""
    return (a * _pow(b_bytes) + b) % P


def fingerprints_of(parts: list[bytes]) -> np.ndarray:
    """(len(parts), 4) residues, of chunks hashed by one matrix product: exact in doubles, as sums stay under 2^53."""
    out = np.zeros((len(parts), 4), np.int64)
    start = 0
    while start < len(parts):
        if len(parts[start]) > SEGMENT:
            whole = parts[start]
            acc = np.zeros(4, np.int64)
            for at in range(0, len(whole), SEGMENT):
                piece = whole[at : at + SEGMENT]
                acc = combine(acc, fingerprints_of([piece])[0], len(piece))
            out[start] = acc
            start += 1
            continue
        end, size = start, 0
        while end < len(parts) and size + len(parts[end]) <= SEGMENT and len(parts[end]) <= SEGMENT:
            size += len(parts[end]) + CHUNK
            end += 1
        end = max(end, start + 1)
        lens = np.array([len(x) for x in parts[start:end]])
        chunks = np.maximum(1, -(-lens // CHUNK))
        ends = np.cumsum(chunks) * CHUNK
        buf = np.zeros(ends[-1], np.uint8)
        for x, to in zip(parts[start:end], ends, strict=True):  # zeros in front don't change a polynomial
            if x:
                buf[to - len(x) : to] = np.frombuffer(x, np.uint8)
        own = (buf.reshape(-1, CHUNK).astype(np.float64) @ _WITHIN).astype(np.int64) % P
        after = np.repeat(np.cumsum(chunks), chunks) - 1 - np.arange(len(own))
        own = own * _shifts(int(chunks.max()))[after] % P
        out[start:end] = np.add.reduceat(own, np.cumsum(chunks) - chunks) % P
        start = end
    return out


def _pack(h: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"f1": h[:, 0] << 31 | h[:, 1], "f2": h[:, 2] << 31 | h[:, 3]})


@F.pandas_udf(StructType([StructField("f1", LongType()), StructField("f2", LongType())]))
def _fingerprint(text: pd.Series) -> pd.DataFrame:
    return _pack(fingerprints_of([x.encode("utf-8", "surrogatepass") for x in text]))


def fingerprint_chunks(chunks: DataFrame, doc: str, order: str, data: str) -> DataFrame:
    """Fingerprints of documents whose bytes lie in several rows: each chunk is hashed where it is, and the sums of the
    shifted chunk hashes meet. Returns doc, n_bytes, f1, f2. A null chunk is empty."""
    rows = chunks.select(F.col(doc).alias("doc"), F.col(order).alias("o"), F.coalesce(F.col(data), F.lit("").cast("binary")).alias("d"))

    @F.pandas_udf("array<long>")
    def hashed(d: pd.Series) -> pd.Series:
        return pd.Series(list(fingerprints_of([bytes(x) for x in d])))

    one = rows.select("doc", "o", F.length("d").cast("long").alias("n"), hashed("d").alias("h"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        acc, n = np.zeros(4, np.int64), 0
        for h, k in zip(*(g.sort_values("o")[c] for c in ("h", "n")), strict=True):
            acc, n = combine(acc, np.asarray(h), int(k)), n + int(k)
        return pd.DataFrame({"doc": [g["doc"].iloc[0]], "n_bytes": [n]}).join(_pack(acc[None]))

    return one.groupBy("doc").applyInPandas(fold, f"doc {dict(one.dtypes)['doc']}, n_bytes long, f1 long, f2 long").withColumnRenamed("doc", doc)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty and equal each other. Of equal texts, the row with the largest id stays; a null id is the
    smallest. Rows that repeat an id and its text count each, and one of them stays. Other columns are ignored, whatever
    their names; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["n", "f1", "f2", "sub"]
    marks = rows.select(
        "id", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("xx"), F.sha2("text", 256).alias("sha"), _fingerprint("text").alias("f")
    ).select("id", "n", "xx", "sha", "f.f1", "f.f2", F.lit(0).alias("sub"), F.monotonically_increasing_id().alias("rid"))
    marks = stage(marks)
    turn = 0
    while True:
        # staged, so that a large group's rows meet its one row by a broadcast, or by a join that adaptive execution splits
        reps = stage(marks.groupBy(key).agg(F.max(F.struct("id", "rid", "xx")).alias("keep"), F.count("*").alias("size")).where("size > 1"))
        found = _differing(rows, marks, small(reps), key, turn)
        if found is None:
            break
        turn += 1
        odd = found.select(F.col("id").alias("oid"), F.col("xx").alias("oxx"), F.lit(1).alias("odd"))
        again = stage(
            marks.join(odd, F.col("id").eqNullSafe(F.col("oid")) & (F.col("xx") == F.col("oxx")), "left")
            .select("id", "n", "xx", "sha", "f1", "f2", F.when(F.col("odd") == 1, F.lit(turn)).otherwise(F.col("sub")).alias("sub"), "rid")
        )
        unstage(marks, reps)
        marks = again
    out = marks.join(small(reps), key, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep.rid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _differing(rows: DataFrame, marks: DataFrame, reps: DataFrame, key: list[str], turn: int) -> DataFrame | None:
    """The rows of the newest groups whose text differs from that of the row that stays; None if there are none."""
    pairs = (
        marks.where(F.col("sub") == turn).join(reps, key).where("rid <> keep.rid")
        .select("id", "xx", F.col("keep.id").alias("kid"), F.col("keep.xx").alias("kxx"))
        .where(~(F.col("id").eqNullSafe(F.col("kid")) & (F.col("xx") == F.col("kxx")))).distinct()
    )
    pairs = stage(pairs)
    if not (n := pairs.count()):
        return None
    texts = rows.select("id", F.xxhash64("text").alias("xx"), "text")
    bytes_ = F.col("text").cast("binary")
    chunks = F.expr(f"sequence(0L, cast((octet_length(text) - 1) div {COMPARE} as long))")

    def cut(wanted: DataFrame, i: str, x: str) -> DataFrame:
        near = F.broadcast(wanted) if n <= broadcast_rows(wanted) else wanted
        met = texts.join(near, texts["id"].eqNullSafe(near[i]) & (texts["xx"] == near[x]))
        return met.select(*wanted.columns, bytes_.alias("b"), F.explode(chunks).alias("c")).select(
            *wanted.columns, "c", F.expr(f"substring(b, cast(c * {COMPARE} + 1 as int), {COMPARE})").alias("piece"))

    keepers = pairs.select("kid", "kxx").distinct()
    mine = cut(pairs.withColumnsRenamed({"id": "mid", "xx": "mxx"}), "mid", "mxx")
    theirs = cut(keepers, "kid", "kxx").dropDuplicates(["kid", "kxx", "c"]).select(F.col("kid").alias("tid"), F.col("kxx").alias("txx"), F.col("c").alias("tc"), F.col("piece").alias("other"))
    met = mine.join(theirs, F.col("kid").eqNullSafe(F.col("tid")) & (F.col("kxx") == F.col("txx")) & (F.col("c") == F.col("tc")), "left")
    odd = met.where(~F.col("piece").eqNullSafe(F.col("other"))).select(F.col("mid").alias("id"), F.col("mxx").alias("xx")).distinct()
    found = stage(odd)
    unstage(pairs)
    return None if found.isEmpty() else found


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
