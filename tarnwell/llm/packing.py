"""Token ids packed into rows of one length, by best fit decreasing.

A task tokenizes its documents and cuts them losslessly into pieces of at most a row. From a window of pieces, longest
first, each goes to the row with the least room that still holds it: a segment tree over room left, from 0 to a row's
length, finds that room in logarithmic time. Windows are bounded by tokens, so memory is too; nothing is shuffled. Rows
so depend on how the input's files are split; nothing is lost, and rows fill nearly as well as from one window.

A packed row has its ids (little-endian 16-bit, filled up with the filler), the cumulative lengths of its segments, the
places where positions start again at 0, and each segment's document and place in it, which give every document back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how text is split before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW, FILLER = 2048, 50256
#: Tokens of a window of pieces that are packed together.
WINDOW = 2_000_000


@lru_cache(maxsize=2)
def _encoding(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Room:
    """A segment tree over amounts of room: how many open rows have each amount, and the least amount from one on."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, room: int) -> int | None:
        """The least amount >= room that an open row has."""
        at = room + self.size
        if self.count[at]:
            return room
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Places of lengths (each 1 to row) in each row, by best fit decreasing; ties by place."""
    room, rows = Room(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left = room.least(n)
        if left is None:
            at, left = len(rows), row
            rows.append([])
        else:
            at = room.take(left)
        rows[at].append(i)
        if left - n:
            room.add(left - n, at)
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, row: int = ROW, filler: int = FILLER, window: int = WINDOW) -> DataFrame:
    """row_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids, piece_from.

    Null and empty texts have no tokens and are in no row. Documents longer than a row are cut into full rows and a
    rest. Rows that repeat are packed each. row_id is unique; rows are made in the order of the input's files. Other
    columns are ignored, whatever their names. vocabulary: a file of ranks, of fewer than 65536 ids, on the driver.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    held = docs.sparkSession.sparkContext.broadcast(content)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text <> ''")

    def packed(pieces: list[tuple], part: int, done: int) -> pd.DataFrame:
        out = []
        for k, chosen in enumerate(best_fit([len(p[2]) for p in pieces], row)):
            ends = np.cumsum([len(pieces[i][2]) for i in chosen])
            ids = np.full(row, filler, np.uint16)
            ids[: ends[-1]] = np.concatenate([pieces[i][2] for i in chosen])
            starts = [0, *ends[:-1].tolist()]
            out.append(((part << 33) + done + k, int(ends[-1]), ids.astype("<u2").tobytes(), [0, *ends.tolist()], starts, [pieces[i][0] for i in chosen], [pieces[i][1] for i in chosen]))
        return pd.DataFrame(out, columns=["row_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "piece_from"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, part = _encoding(held.value), TaskContext.get().partitionId()
        pieces, size, done = [], 0, 0
        for frame in frames:
            for doc, text in zip(frame["id"], frame["text"], strict=True):
                ids = np.array(encoding.encode_ordinary(text), np.uint16)
                pieces += [(doc, at, ids[at : at + row]) for at in range(0, len(ids), row)]
                size += len(ids)
                if size >= window:
                    made = packed(pieces, part, done)
                    yield from (made.iloc[at : at + 2000] for at in range(0, len(made), 2000))
                    pieces, size, done = [], 0, done + len(made)
        if pieces:
            made = packed(pieces, part, done)
            yield from (made.iloc[at : at + 2000] for at in range(0, len(made), 2000))

    out = rows.mapInPandas(run, "row_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<string>, piece_from array<int>")
    return out.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>"))


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id, piece_from, input_ids (bytes) of every segment."""
    cut = F.expr("substring(input_ids, 2 * cu_seqlens[i] + 1, 2 * (cu_seqlens[i + 1] - cu_seqlens[i]))")
    return packed.select("*", F.posexplode("doc_ids").alias("i", "doc_id")).select("doc_id", F.expr("piece_from[i]").alias("piece_from"), cut.alias("input_ids"))


def write_binary(packed: DataFrame, path: str) -> None:
    """The rows as Parquet: fixed-length id rows that read as one (rows, ROW) matrix, with their segments beside them."""
    packed.write.mode("overwrite").parquet(path)


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
