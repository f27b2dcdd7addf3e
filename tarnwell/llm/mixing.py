"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot k of the schedule has the point frac(k / golden ratio), here k * 2654435769 modulo 2^32; the sources' shares cut
the unit interval, and the point's cut names the slot's source. The r-th slot of a source takes block r of its shuffled,
equally long blocks of words, and starts again at the first block after the last. A source's slots are settled in words:
as many as come nearest its target. What the points give it over that is not taken, and what they give it too little, a
few slots at most, follows at the end. Blocks are equally long in all sources, but for those that have few: their blocks
are a small share of the source, so that small sources meet their targets beside a corpus of any size. Prefix sums over a
source run in two levels, by slices of the shuffle key, so that no task holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_rows, small, stage, table

WORD = r"[^\x20\x09-\x0D]+"
#: Slots that a schedule has about while its blocks are within these words, and blocks that a source is cut into at least
#: if it has as many words.
SLOTS = 1 << 20
LEAST_BLOCK, MOST_BLOCK = 16, 4096
LEAST_BLOCKS = 1000
#: Slots of a slice that one task ranks.
SLICE = 4096
#: The golden ratio's fraction, of 2^32.
GOLDEN = 2654435769
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


@dataclass
class Mix:
    """docs: rid, id, source, size, sidx, at (first word's place in the shuffled source); sources; schedule: slot,
    sidx, rank, block, epoch; pieces: rid, sidx, block, words."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """rid, taken: words that the mix takes of each document that it takes any of, repeats counted."""
        times = self.schedule.groupBy("sidx", "block").agg(F.count("*").alias("times"))
        return self.pieces.join(times, ["sidx", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sizes: source, size, one row per source. Adds sidx, weight, total and target.

    Sources by code point, null last, weigh as weights says, over and over. They share the total by weight; a target
    stops at most times its source's size, and what is over is shared again by weight until none is above. With
    sources by cap / weight, that is the first level (total - caps before) / (weights from here) under the own ratio.
    """
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sidx"), F.lit(n)) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", "sidx")
    out = sizes.withColumn("sidx", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    out = out.withColumn("cap", F.col("size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("total", F.sum("size").over(everywhere))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.col("total") - before) / after)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sidx", "level"))
    out = out.withColumn("level", F.min(fits).over(everywhere)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return out.withColumn("target", target).select("source", "sidx", "weight", "size", "total", "target")


def before_each(df: DataFrame, group: str, slices: Column, order: list, amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows of its group before it, by (slice, order)."""
    df = df.withColumn("_slice", slices)
    sums = df.groupBy(group, "_slice").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_slice", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, [group, "_slice"])
    return out.withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_slice", "_start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST_REPEATS, slots: int = SLOTS) -> Mix:
    """The schedule and the words that it takes.

    Null and empty texts have no words: their rows stay in docs and nothing takes them. A null source is a source. The
    shuffle is by MD5 of the id, or of the text's hash without one; rows that repeat an id lie side by side, in any order. Other columns are ignored. With
    no words at all, targets are 0 and the schedule is empty. A source's last block may be shorter than the others.
    """
    text_hash = F.xxhash64(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), text_hash.cast("string"))), 1, 16).alias("key"),
        text_hash.alias("hash"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = stage(rows)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    block = F.least(F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("total") / slots)), F.lit(MOST_BLOCK))
    sources = sources.withColumn("block_words", F.greatest(F.lit(1), F.least(block, F.floor(F.col("size") / LEAST_BLOCKS))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("size") / F.col("block_words")))
    whole = F.floor(F.col("target") / F.col("size"))
    quota = whole * F.col("blocks") + F.floor((F.col("target") - whole * F.col("size")) / F.col("block_words") + 0.5)
    sources = stage(sources.withColumn("quota", F.when(F.col("size") > 0, quota).otherwise(F.lit(0)).cast("long")))
    known = sources.agg(F.sum("quota"), F.count("*")).first()
    n_slots, n_sources = known[0] or 0, max(1, known[1])
    shares = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(Window.orderBy("sidx")))
    shares = shares.select("sidx", "blocks", "quota", ((F.col("hi") - F.col("quota")) / F.lit(max(1, n_slots))).alias("lo"), (F.col("hi") / F.lit(max(1, n_slots))).alias("hi"))
    grid = 4 * n_sources
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1).cast("long")))))
    spark = docs.sparkSession
    slot = F.col("id")
    turn = F.shiftleft((F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF)) * F.lit(GOLDEN)).bitwiseAND(F.lit(0xFFFF)), 16) + slot.bitwiseAND(F.lit(0xFFFF)) * F.lit(GOLDEN)
    point = spark.range(n_slots).select(slot.alias("slot"), (F.pmod(turn, F.lit(1 << 32)) / F.lit(float(1 << 32))).alias("p"))  # in two halves: products stay under 2^63
    point = point.withColumn("cell", F.floor(F.col("p") * grid))
    drawn = point.join(F.broadcast(cells) if 2 * grid <= broadcast_rows(cells) else cells, "cell").where("p >= lo AND p < hi").select("slot", "sidx", "blocks", "quota")
    drawn = stage(before_each(drawn, "sidx", F.floor(F.col("slot") / SLICE), ["slot"], F.lit(1), "rank"))
    got = drawn.groupBy("sidx").agg(F.count("*").alias("got"))
    short = shares.join(got, "sidx", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    ahead = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("slot", n_slots + F.coalesce(F.sum(F.col("quota") - F.col("got")).over(ahead), F.lit(0)))
    late = short.select("sidx", "blocks", "slot", "got", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    ranked = drawn.where("rank < quota").select("slot", "sidx", "rank", "blocks").unionAll(late.select((F.col("slot") + F.col("rank") - F.col("got")).alias("slot"), "sidx", "rank", "blocks"))
    schedule = ranked.select("slot", "sidx", "rank", F.pmod("rank", "blocks").alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))
    named = small(sources.select(F.col("source").alias("s"), "sidx", "target", F.col("size").alias("source_size"), "block_words"))
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    digits, many = 0, rows.count()
    while digits < 8 and many > 128 * 16**digits:
        digits += 1
    placed = before_each(placed, "sidx", F.substring("key", 1, digits), ["key", "id", "rid"], F.col("size"), "at")
    span = F.sequence(F.floor(F.col("at") / F.col("block_words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_words")))
    pieces = placed.where("size > 0").select("rid", "sidx", "at", "size", "block_words", F.explode(span).alias("block")).select(
        "rid", "sidx", "block", (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest("at", F.col("block") * F.col("block_words"))).alias("words"))
    return Mix(placed, sources, schedule, pieces)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, to the nearest whole text; all columns stay as they are. Rows
    that repeat an id and its text share what the mix takes of them evenly."""
    made = mix(docs, id_col, text_col, source_col, **options)
    often = made.docs.join(made.taken(), "rid").groupBy("id", "hash").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    often = stage(often.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "times"))
    near = small(often)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_text"))
    met = rows.join(near, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    return made.docs.join(made.taken(), "rid", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(doc_id::VARCHAR), 1, 16) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx FROM d GROUP BY source
), s2 AS (
  SELECT *, 1 + sidx % 3 AS weight, 3 * size AS cap, (3 * size)::DOUBLE / (1 + sidx % 3) AS ratio,
         (sum(size) OVER ())::BIGINT AS total FROM s
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY ratio, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2
), lv AS (SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, sidx LIMIT 1
), s4 AS (
  SELECT source, sidx, size, least(cap::DOUBLE, (SELECT level FROM lv) * weight) AS target,
         greatest(1, least(least(greatest(16, ceil(total / 1048576.0)), 4096), size // 1000))::BIGINT AS b FROM s3
), s5 AS (
  SELECT *, ceil(size::DOUBLE / b)::BIGINT AS blocks, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM s4
), s6 AS (
  SELECT *, CASE WHEN size > 0 THEN whole * blocks + floor((target - whole * size) / b + 0.5) ELSE 0 END::BIGINT AS quota FROM s5
), s7 AS (
  SELECT sidx, blocks, quota, (sum(quota) OVER (ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS hi, (sum(quota) OVER ())::BIGINT AS n FROM s6
), k AS (
  SELECT slot, ((slot * 2654435769) % 4294967296)::DOUBLE / 4294967296.0 AS p FROM (SELECT unnest(range((SELECT max(n) FROM s7))) AS slot)
), r AS (
  SELECT s7.sidx, row_number() OVER (PARTITION BY s7.sidx ORDER BY k.slot) - 1 AS rank
  FROM k JOIN s7 ON k.p >= (s7.hi - s7.quota)::DOUBLE / s7.n AND k.p < s7.hi::DOUBLE / s7.n WHERE s7.quota > 0
), c AS (SELECT sidx, count(*) AS got FROM r GROUP BY 1
), q AS (
  SELECT r.sidx, r.rank, s7.blocks FROM r JOIN s7 USING (sidx) WHERE r.rank < s7.quota
  UNION ALL
  SELECT sidx, unnest(range(coalesce(got, 0), quota)) AS rank, blocks FROM s7 LEFT JOIN c USING (sidx) WHERE coalesce(got, 0) < quota
), t AS (SELECT sidx, rank % blocks AS block, count(*) AS times FROM q GROUP BY 1, 2
), p AS (
  SELECT d.doc_id, d.size, s5.sidx, s5.size AS source_size, s5.target, s5.b,
         coalesce(sum(d.size) OVER (PARTITION BY s5.sidx ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
), x AS (
  SELECT *, unnest(range(st // b, (st + size - 1) // b + 1)) AS block FROM p WHERE size > 0
), y AS (
  SELECT x.doc_id, sum((least(st + size, (x.block + 1) * b) - greatest(st, x.block * b)) * t.times)::BIGINT AS taken
  FROM x JOIN t ON x.sidx = t.sidx AND x.block = t.block GROUP BY 1
)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, coalesce(y.taken, 0)::BIGINT AS taken FROM p LEFT JOIN y USING (doc_id)
"""
