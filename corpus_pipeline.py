"""A corpus from documents: quality, near duplicates, benchmark passages, mixture, packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import decontam, jaccard, mixing, packing, quality
from tarnwell.llm.common import light, small, stage, table
from tarnwell.sources import staged


def _own(docs: DataFrame) -> DataFrame:
    """docs as one struct, so that no column of theirs can clash, with what rows are known by."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (id, hash). Rows with one of the two only stay, and null ids are an id."""
    out = _own(docs).join(small(stage(gone)), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_anti")
    return out.select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go. It is fitted on labelled documents of the whole table; without labels all
    documents score alike, and 0.5 stays. Null and empty texts are scored like others. Rows that repeat stay or go alike;
    an empty table gives an empty table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    net = quality.train(table(spark, sf_dir, "documents"), labels, quality.held_out)
    return docs.where(quality.probability(spark, net)("text") >= 0.5)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id; of rows that repeat an id and its text
    one. Texts without words, null ones too, are alone and stay. An empty table gives an empty table."""
    light(spark)
    classes = stage(jaccard.jaccard_classes(docs).select(F.col("doc_id").alias("id"), F.col("xx").alias("hash"), "kept"))
    rows = classes.groupBy("id", "hash").agg(F.max("kept").alias("kept"), F.count("*").alias("many"))
    gone = rows.where("NOT kept").select("id", "hash")
    if rows.where("kept AND many > 1").isEmpty():
        return _without(docs, gone)
    once = _own(docs).dropDuplicates(["own_id", "own_hash"]).select("row.*")  # rows that repeat an id and its text
    return _without(once, gone)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, by id and text: others with their id or without one stay. Null
    and empty texts overlap with nothing. Rows that repeat go alike; an empty table gives an empty table."""
    keyed = _own(docs).select(F.struct(F.col("own_id").alias("id"), F.col("own_hash").alias("hash")).alias("key"), F.col("row.text").alias("text"))
    found = decontam.overlaps(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    return _without(docs, found.select("key.id", "key.hash").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. Null and empty texts have no words and are not taken; a null
    source is a source; an empty table gives an empty table."""
    light(spark)
    return mixing.mixed_rows(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids. Null and empty texts have no tokens and are in no row; rows that repeat are packed each;
    an empty table gives an empty table."""
    light(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_packing),
]

#: The network and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        since = staged.mark()
        docs = stage(step(spark, docs, sf_dir))
        staged.release(spark, since, docs)  # what the stage itself had written
    return STAGES[-1][1](spark, docs, sf_dir)
