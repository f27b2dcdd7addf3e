"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; equal sets are one class member with a number of copies. A set is
embedded as 64 minwise hashes, so that two sets agree on a share of coordinates that is their similarity. A run starts
with all sets in one bucket and splits it recursively: a bucket's path picks each coordinate with probability
1 / (LAMBDA * 64), and a set goes on to one bucket for each picked coordinate, by its hash there. A pair at the
threshold survives a level like a branching process of mean threshold / LAMBDA; runs repeat until a pair at the
threshold meets in a deepest bucket with the target recall. Buckets that are small enough stop splitting early.

The first FIRST runs make a first join cheap: each member's sketch is compared with that of its bucket's least member. A
member has few different least members in its buckets, so this takes a few rows a member however large a group is, and
joins nearly all of a group of near copies in one component. Of all runs' buckets, those whose members are all in one
component have nothing left to find and end there. The others go on: small ones are compared by brute force on the
sketches, large ones are split on, and what no further splitting parts is compared in blocks, each pair of blocks a group
of its own. What meets makes candidate clusters; within a cluster, blocks of whole shingle sets give the exact
similarities. No pair becomes a row: a block gives counts of links and one star for each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..sources.staged import mark, release
from . import tokens
from .common import broadcast_rows, grouped, small, stage, table, unstage
from .components import components

WORDS, THRESHOLD = 5, 0.8
COORDINATES, LAMBDA = 64, 0.8
#: Levels that every set is split, and at most; the sets of a bucket that stops early; the recall at the deepest level.
START, DEEPEST, SMALL, RECALL = 4, 6, 1024, 0.99
#: Runs of the first join.
FIRST = 3
#: Share of equal coordinates from which a pair is a candidate: four standard deviations under the threshold.
CANDIDATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / COORDINATES) ** 0.5
#: Sketches of a block.
BLOCK_SKETCHES = 2048
#: Sets and shingles of a block of whole sets.
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000

_MULT = tokens.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_PICK = tokens.mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
_LIMIT = np.uint64(int(2.0**64 / (LAMBDA * COORDINATES)))


def survival(depth: int, similarity: float = THRESHOLD) -> float:
    """The probability that a pair of that similarity shares a bucket of that depth in one run."""
    s = 1.0
    for _ in range(depth):
        s = 1 - (1 - s * similarity / (LAMBDA * COORDINATES)) ** COORDINATES
    return s


RUNS = ceil(log(1 - RECALL) / log(1 - survival(DEEPEST)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, np.multiply.outer(shingles[at : at + 1024], _MULT).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def children(sig: np.ndarray, row: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the (row, path) of each coordinate that a path picks. sig: (rows, COORDINATES)."""
    rows, paths = [], []
    for at in range(0, len(path), 1 << 14):
        r, p = row[at : at + (1 << 14)], path[at : at + (1 << 14)]
        k, i = np.nonzero(tokens.mix(p[:, None] ^ _PICK) < _LIMIT)
        rows.append(r[k])
        paths.append(tokens.mix(p[k] * np.uint64(0x9E3779B97F4A7C15) + _PICK[i] + sig[r[k], i].astype(np.uint64)))
    return (np.concatenate(rows), np.concatenate(paths)) if rows else (row[:0], path[:0])


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingles of each text, sorted and each once."""
    for a, b in tokens.batches(texts):
        shingles, at = tokens.shingles(*tokens.words(texts[a:b]), WORDS)
        for i in range(b - a):
            yield np.unique(shingles[at[i] : at[i + 1]])


_MEMBERS = "bucket long, rep long, comp long"
_DESCRIBED = StructType([StructField("n", LongType()), StructField("f1", LongType()), StructField("f2", LongType()), StructField("sig", BinaryType())])


@F.pandas_udf(_DESCRIBED)
def _described(text: pd.Series) -> pd.DataFrame:
    """Size, fingerprint and minwise hashes of each text's set."""
    n, f1, f2, sig = [], [], [], []
    for s in _sets(list(text)):
        n.append(len(s))
        f1.append(int(tokens.mix(s).sum(dtype=np.uint64).astype(np.int64)))
        f2.append(int(tokens.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
        sig.append(minhash(s).tobytes() if len(s) else None)
    return pd.DataFrame({"n": n, "f1": f1, "f2": f2, "sig": sig})


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDINATES)


def _buckets(sketches: DataFrame, runs: range) -> DataFrame:
    """Staged bucket, rep, comp of the runs' buckets at level START. sketches: rep, sig, comp."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = tokens.mix(np.arange(1 + runs.start, 1 + runs.stop, dtype=np.uint64))
        for whole in frames:
            for at in range(0, len(whole), 1000):
                frame = whole.iloc[at : at + 1000]
                sig = _matrix(frame["sig"])
                row, path = np.repeat(np.arange(len(sig)), len(roots)), np.tile(roots, len(sig))
                for _ in range(START):
                    row, path = children(sig, row, path)
                yield pd.DataFrame({"bucket": path.view(np.int64), "rep": frame["rep"].to_numpy()[row], "comp": frame["comp"].to_numpy()[row]}).drop_duplicates()

    return stage(sketches.mapInPandas(cut, _MEMBERS))


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = [np.array([x["bucket"] for x in rows], np.int64) for rows in frame["own"]]
        row, path = children(_matrix(frame["sig"]), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own).view(np.uint64))
        yield pd.DataFrame({"bucket": path.view(np.int64), "rep": frame["rep"].to_numpy()[row], "comp": frame["comp"].to_numpy()[row]}).drop_duplicates()


@F.pandas_udf(BooleanType())
def _alike(one: pd.Series, other: pd.Series) -> pd.Series:
    """Whether two sketches make a candidate."""
    return pd.Series((_matrix(one) == _matrix(other)).mean(1) >= CANDIDATE if len(one) else [], dtype=bool)


class _Union:
    """Union-find over places 0 to n - 1; the root is the smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self, names: np.ndarray) -> tuple[list, list]:
        links = [(names[i], names[r]) for i in range(len(self.up)) if (r := self.find(i)) != i]
        return [a for a, _ in links], [b for _, b in links]


def _near(group: pd.DataFrame) -> pd.DataFrame | None:
    """Links between the components of a bucket, or of a pair of blocks, by candidates in different ones."""
    sig, block, p, q = _matrix(group["sig"]), group["block"].to_numpy(), group["p"].iloc[0], group["q"].iloc[0]
    names, comp, many = np.unique(group["comp"].to_numpy(), return_inverse=True, return_counts=True)
    known, out = _Union(len(names)), []
    for i in np.flatnonzero(comp != many.argmax()):  # the largest component's members are met by all others
        same = (comp != comp[i]) & ((sig[i] == sig).mean(1) >= CANDIDATE)
        if p != q:
            same &= block[i] != block
        for c in np.unique(comp[same]).tolist():
            if known.find(int(comp[i])) != known.find(c):
                known.join(int(comp[i]), c)
                out.append((names[comp[i]], names[c]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else None


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets) sizes of intersections, by products of incidence blocks over the shingles that any two share."""
    m = len(sets)
    value, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = many[column] > 1
    row, column = row[keep], (np.cumsum(many > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, wide = np.zeros((m, m), np.float32), max(64, (1 << 21) // m)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        x = np.zeros((m, wide), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _linked(group: pd.DataFrame) -> pd.DataFrame | None:
    """(a, null, links) and (a, b, null) of a cluster's, or a pair of blocks', exact links."""
    group = group.drop_duplicates("rep")
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    if len(sets) < 2:
        return None
    block, p, q = group["block"].to_numpy(), group["p"].iloc[0], group["q"].iloc[0]
    both, n = overlaps(sets).astype(np.float64), np.array([len(s) for s in sets], float)
    linked = both >= THRESHOLD * (n[:, None] + n - both) - 1e-9
    np.fill_diagonal(linked, False)
    if p != q:
        linked &= block[:, None] != block
    if not linked.any():
        return None
    names, links = group["rep"].to_numpy(), linked @ group["copies"].to_numpy()
    known = _Union(len(sets))
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        known.join(int(i), int(j))
    a, b = known.stars(names)
    has = links > 0
    return pd.DataFrame({"a": [*names[has], *a], "b": [*[None] * has.sum(), *b], "w": [*links[has], *[None] * len(a)]}).astype("Int64")


def _blocked(members: DataFrame, blocks) -> DataFrame:
    """members with block, p, q: one row for each pair of blocks that the own block is in."""
    out = members.withColumn("many", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("many")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))
    return out.withColumn("other", other).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", "many")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links, kept, xx (the text's hash): one row per row.

    n_links counts the other rows whose shingle sets are as similar as the threshold at least, copies included;
    class_id is the smallest id of the rows that chains of such links reach, and kept marks one row of each class, with
    that id. Texts of one to four words have one shingle of all their words. Texts without words, null ones too, have
    no shingles and are alone. Rows that repeat an id and its text are copies. Null ids are links like any other, and
    are the class_id only of classes that have no other. Other columns are ignored, whatever their names.
    """
    since = mark()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("xx", F.xxhash64("text"))
    every = stage(rows.select("id", "xx", _described("text").alias("d"), F.monotonically_increasing_id().alias("rid")).select("id", "xx", "rid", "d.*"))
    key = ["n", "f1", "f2"]
    reps = stage(every.where("n > 0").groupBy(key).agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "rid"))).alias("head")))
    sketches = every.join(reps.select("rep"), F.col("rid") == F.col("rep")).select("rep", "id", "xx", "n", "sig")
    sketches = stage(sketches)

    clusters = _candidate_clusters(sketches).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    found = _exact_links(rows, sketches, reps, clusters)
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("links"))

    named = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    heads = named.groupBy("root").agg(F.min("head").alias("first"), F.min("rep").alias("any"))
    named = named.join(heads, "root").join(links, "rep", "left").select(*key, "rep", "copies", "first", "any", "links")
    named = stage(named)
    release(docs.sparkSession, since, every, named)
    out = every.join(named, key, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(F.col("rep").isNull(), F.lit(0).cast("long")).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"),
        F.when(F.col("rep").isNull(), F.lit(True)).otherwise(F.col("rid") == F.coalesce("first.rid", "any")).alias("kept"),
        "xx",
    )


def _with_sketches(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """rep, sig, comp and own, the list of the other columns, of members (staged): a set is in tens of buckets, and its sketch
    moves once. The lists are broadcast where members' rows would be."""
    lists = members.groupBy("rep", "comp").agg(F.collect_list(F.struct(*[c for c in members.columns if c not in ("rep", "comp")])).alias("own"))
    return sketches.select("rep", "sig").join(F.broadcast(lists) if members.count() <= broadcast_rows(members) else lists, "rep")


def _mixed(members: DataFrame) -> DataFrame:
    """Staged bucket, many, center, last (the least and the greatest member) of the buckets with more than one component.
    Partial aggregates meet, so a bucket that very many sets share is counted in parts."""
    return stage(
        members.groupBy("bucket").agg(F.count("*").alias("many"), F.min("rep").alias("center"), F.max("rep").alias("last"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        .where("x <> y").select("bucket", "many", "center", "last")
    )


def _alike_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Staged a, b of the pairs (rep, center) whose sketches make a candidate. Only the sketches of sets that are in a pair
    are moved: most sets are in none."""
    pairs = stage(pairs)
    named = stage(pairs.select("rep").unionAll(pairs.select(F.col("center").alias("rep"))).distinct())
    own = stage(sketches.select("rep", "sig").join(small(named), "rep"))
    ours, theirs = own.select("rep", F.col("sig").alias("one")), own.select(F.col("rep").alias("center"), F.col("sig").alias("other"))
    return stage(ours.join(small(pairs), "rep").join(theirs, "center").where(_alike("one", "other")).select(F.col("rep").alias("a"), F.col("center").alias("b")))


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what is known (node, root) and of more links a, b."""
    return known if links.isEmpty() else components(links.unionAll(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _candidate_clusters(sketches: DataFrame) -> DataFrame:
    """Staged node, root: candidates' components."""
    two = lambda mixed: mixed.where("many = 2").select(F.col("last").alias("rep"), "center")
    members = _buckets(sketches.select("rep", "sig", F.col("rep").alias("comp")), range(FIRST))
    mixed = _mixed(members)
    near = members.select("bucket", "rep").join(small(mixed.where("many > 2").select("bucket", "center")), "bucket").where("rep <> center").select("rep", "center")
    known = components(_alike_pairs(two(mixed).unionAll(near).distinct(), sketches))
    unstage(members, mixed)

    placed = sketches.select("rep", "sig").join(small(known.select(F.col("node").alias("rep"), "root")), "rep", "left").select("rep", "sig", F.coalesce("root", "rep").alias("comp"))
    members = _buckets(placed, range(RUNS))
    mixed = _mixed(members)
    pairs = _alike_pairs(two(mixed).distinct(), sketches)
    now = stage(members.join(small(mixed.where("many > 2").select("bucket", "many")), "bucket"))
    unstage(members, mixed)
    leaves = None
    for depth in range(START, DEEPEST + 1):
        whole = (now if depth == DEEPEST else now.where(F.col("many") <= SMALL)).withColumn("level", F.lit(depth))
        leaves = whole if leaves is None else leaves.unionAll(whole)
        large = now.where(F.col("many") > SMALL)
        if depth == DEEPEST or large.isEmpty():
            break
        split = stage(_with_sketches(stage(large.select("bucket", "rep", "comp")), sketches).mapInPandas(_split, _MEMBERS))
        now = stage(split.join(small(_mixed(split).select("bucket", "many")), "bucket"))
    sizes = leaves.groupBy("level", "bucket", "many").agg(F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"))
    chosen = stage(sizes.groupBy("many", "x1", "x2").agg(F.min(F.struct("level", "bucket")).alias("one")).select("one.level", "one.bucket"))
    if chosen.isEmpty():
        return _joined(known, pairs)
    in_them = _with_sketches(stage(leaves.join(small(chosen), ["level", "bucket"])), sketches).select("rep", "sig", "comp", F.inline("own"))
    blocked = _blocked(in_them, F.ceil(F.col("many") / BLOCK_SKETCHES))
    found = stage(grouped(blocked.select("level", "bucket", "p", "q", "block", "rep", "comp", "sig"), ["level", "bucket", "p", "q"], _near, "a long, b long").distinct())
    return _joined(known, stage(pairs.unionAll(found)))


def _exact_links(rows: DataFrame, sketches: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    wanted = clusters.join(sketches.select("rep", "id", "xx", "n"), "rep").join(reps.select("rep", "copies"), "rep")
    sizes = clusters.join(sketches.select("rep", "n"), "rep").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    wanted = stage(wanted.join(sizes, "cluster").select("rep", "cluster", "blocks", "copies", F.col("id").alias("wid"), F.col("xx").alias("wxx")))
    texts = rows.join(small(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("xx") == F.col("wxx"))).select("cluster", "blocks", "rep", "copies", "text")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(shingles=[s.tobytes() for s in _sets(list(frame["text"]))])

    sets = texts.mapInPandas(cut, "cluster long, blocks long, rep long, copies long, shingles binary")
    blocked = _blocked(sets, F.col("blocks"))
    return stage(grouped(blocked.select("cluster", "p", "q", "block", "rep", "copies", "shingles"), ["cluster", "p", "q"], _linked, "a long, b long, w long"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
