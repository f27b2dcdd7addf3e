"""Benchmark decontamination by spaced seeds.

A seed's mask says which of a window's words count; the others may be anything. The hashes of the benchmark's windows
under each mask are joined with those of the documents' windows, and around every hit document and item are laid side
by side: of the stretches of which four in five words are equal, the one with most equal words is an overlap if they are
enough. So a passage is found although words in it were replaced, as long as four in five stay: the masks together leave
no way to place the replaced words of LEAST_EQUAL or more equal ones such that none of them hits. Items of few words
have further masks, and up to LEAVE_ONE words seeds of all their words and of all but one.

The benchmark is cut into parts of bounded size; each part is an index of its own, sent to the tasks, and the documents
are read once for each part. Benchmarks of up to PART_WORDS words, about a hundred thousand items, are one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table

#: Fixed masks: 1 marks the words of a window that count.
MASKS = ("111101011", "110110010111", "1101000110111", "11100101001101", "1101110001", "111111")
#: Equal words that an overlap has at least, or MOST_SHORT of an item's words where it has fewer; and how many of them
#: each other word in it needs.
LEAST_EQUAL, MOST_SHORT, MISS = 13, 0.8, 4
#: Words of an item at least; shorter ones say nothing.
LEAST_WORDS = 4
#: Further masks for items of few words, and words up to which an item is one of them; words up to which it has seeds that
#: leave out one word each. With MASKS they hit wherever the other words of an item stand, MOST_SHORT of it being equal.
SHORT_MASKS, SHORT = ("11010011", "1100111"), 15
LEAVE_ONE = 7
PART_WORDS = 4_000_000
#: Words of items that are laid beside texts at once.
_BESIDE = 1 << 20
_BITS = 22


def _windows(hashes: np.ndarray, offsets: np.ndarray, places: list[int], span: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of span words that lies in one text, of the words at places."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n, np.uint64(salt))
    for k, at in enumerate(places):
        acc += hashes[at : at + n] * tokens._STEP[k]
    counts = np.diff(offsets)
    left = np.repeat(offsets[1:], counts)[:n] - np.arange(n)
    first = np.flatnonzero(left >= span)
    return tokens.mix(acc[first]), first


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(equal words, first, end) of the stretch with most equal words that has at least MISS of them for each other."""
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS))])
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # for each end the first start from which it has them
    end = int((equal - equal[first]).argmax())
    inside = np.flatnonzero(same[first[end] : end]) + first[end]
    return (len(inside), int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0, 0)


@dataclass
class Index:
    """One part of the benchmark: its items' words, and its windows' hashes in order with item and place."""

    items: list[int]
    words: np.ndarray
    offsets: np.ndarray
    seeds: list[tuple[list[int], int, int]]
    keys: list[np.ndarray]
    where: list[np.ndarray]
    maps: list[np.ndarray]

    @staticmethod
    def of(items: list, texts: list[str | None]) -> Index:
        words, offsets = tokens.words(texts)
        counts = np.diff(offsets)
        longest = max(len(m) for m in MASKS)
        seeds = [([i for i, c in enumerate(m) if c == "1"], len(m), k) for k, m in enumerate(MASKS)]
        short = sorted({int(c) for c in counts if LEAST_WORDS <= c < longest})
        seeds += [(list(range(n)), n, 100 + n) for n in short]
        seeds += [([i for i, c in enumerate(m) if c == "1"], len(m), 50 + k) for k, m in enumerate(SHORT_MASKS) if any(LEAVE_ONE < c <= SHORT for c in counts)]
        seeds += [([i for i in range(n) if i != k], n, 200 + n * longest + k) for n in short if LEAST_WORDS < n <= LEAVE_ONE for k in range(n)]
        out = Index(items, words, offsets, seeds, [], [], [])
        for places, span, salt in seeds:
            h, at = _windows(words, offsets, places, span, salt)
            if 50 <= salt < 100:
                few = counts[np.searchsorted(offsets, at, "right") - 1] <= SHORT
                h, at = h[few], at[few]
            if salt >= 100:  # the whole of a short item, or all of it but a word
                whole = counts[np.searchsorted(offsets, at, "right") - 1] == span
                h, at = h[whole], at[whole]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            out.keys.append(h[order]), out.where.append(at[order]), out.maps.append(seen)
        return out

    def _ways(self, words: np.ndarray, offsets: np.ndarray, scale: tuple[int, int]) -> Iterator[np.ndarray]:
        """Parts of at most some _BESIDE diagonals (text, item, shift), packed into a number, that hits lie on. Hits are laid
        out a part at a time: equal words in a long text and in a long item hit as often as the product of their lengths,
        but lie on no more diagonals than their sum."""
        held, many_held = [], 0
        for (places, span, salt), keys, where, seen in zip(self.seeds, self.keys, self.where, self.maps, strict=True):
            h, at = _windows(words, offsets, places, span, salt)
            hit = seen[h >> np.uint64(64 - _BITS)]
            h, at = h[hit], at[hit]
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            some = hi > lo
            lo, at, many = lo[some], at[some], (hi - lo)[some]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // _BESIDE)) + 1):
                n = many[part]
                steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mine, theirs = np.repeat(at[part], n), where[np.repeat(lo[part], n) + steps]
                text, item = np.searchsorted(offsets, mine, "right") - 1, np.searchsorted(self.offsets, theirs, "right") - 1
                shift = mine - offsets[text] - (theirs - self.offsets[item])
                held.append(np.unique((text * scale[0] + item) * scale[1] + shift + scale[1] // 2))
                many_held += len(held[-1])
                if many_held > 2 * _BESIDE:
                    held = [np.unique(np.concatenate(held))]
                    many_held = len(held[0])
                    if many_held > _BESIDE:
                        yield held[0]
                        held, many_held = [], 0
        if many_held:
            yield np.unique(np.concatenate(held))

    def overlaps(self, texts: list[str | None]) -> list[tuple]:
        """(text, item, equal words, words, first word in the text, first word in the item)."""
        words, offsets = tokens.words(texts)
        longest = max(np.diff(offsets).max(initial=0), np.diff(self.offsets).max(initial=0))
        scale = len(self.items) + 1, 2 * int(longest) + 2
        best: dict[tuple, tuple] = {}
        for ways in self._ways(words, offsets, scale):
            shift = ways % scale[1] - scale[1] // 2
            text, item = ways // scale[1] // scale[0], ways // scale[1] % scale[0]
            counts = np.diff(self.offsets)[item]
            low, high = np.maximum(0, -shift), np.minimum(counts, np.diff(offsets)[text] - shift)
            least = np.minimum(LEAST_EQUAL, np.ceil(MOST_SHORT * counts)).astype(np.int64)
            at = np.cumsum(high - low)
            for some in np.split(np.arange(len(ways)), np.flatnonzero(np.diff(at // _BESIDE)) + 1):
                n = (high - low)[some]
                begin = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(begin[-1]) - np.repeat(begin[:-1] - low[some], n)
                mine, theirs = offsets[text[some]] + shift[some], self.offsets[item[some]]
                same = words[place + np.repeat(mine, n)] == self.words[place + np.repeat(theirs, n)]
                enough = np.flatnonzero(np.add.reduceat(same, begin[:-1], dtype=np.int64) >= least[some])
                for k in enough.tolist():
                    equal, start, end = _stretch(same[begin[k] : begin[k + 1]])
                    w = some[k]
                    t, i, lo = int(text[w]), int(item[w]), int(low[w])
                    found = (equal, -(lo + start + int(shift[w])), -(lo + start), end - start)
                    if equal >= least[w] and found > best.get((t, i), (0,)):
                        best[t, i] = found
        return [(*k, equal, n, -mine, -theirs) for k, (equal, mine, theirs, n) in sorted(best.items())]


def parts(items: DataFrame) -> Iterator[Index]:
    """Indexes over items: item_id, text, a part at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = max(1, -(-size // PART_WORDS))
    part = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        got = sorted((tuple(r) for r in part.where(F.col("part") == k).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r))
        yield Index.of([r[0] for r in got], [r[1] for r in got])


def _finder(spark: SparkSession, index: Index):
    held = spark.sparkContext.broadcast(index)

    @F.pandas_udf("array<struct<item_id: string, equal: long, words: long, doc_from: long, item_from: long>>")
    def found(text: pd.Series) -> pd.Series:
        index, texts = held.value, list(text)
        out: list[list] = [[] for _ in texts]
        for a, b in tokens.batches(texts):
            for t, i, *rest in index.overlaps(texts[a:b]):
                out[a + t].append((index.items[i], *rest))
        return pd.Series(out)

    return found


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, equal, words, doc_from, item_from: one row for each document and item that overlap, with the
    overlap of most equal words, of equally long ones the first in the document. Null and empty texts and items overlap with nothing, nor do items under LEAST_WORDS words. Rows
    that repeat give a row each. Other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = dict(items.dtypes)["item_id"]
    out = None
    for index in parts(items):
        found = _finder(docs.sparkSession, index)
        one = rows.select("id", F.inline(found("text"))).withColumn("item_id", F.col("item_id").cast(kind))
        out = one if out is None else out.unionAll(one)
    return out.withColumnRenamed("id", id_col)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
