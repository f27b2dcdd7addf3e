"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear classifier, in numpy, on hashed features of a text's
distinct words (the word, its beginnings, its character n-grams). The risk on negatives is estimated from unlabelled
text less the positives' share of it, pi R_p(+) + max(0, R_u(-) - pi R_p(-)); where that estimate falls under zero,
the step goes against it, which keeps the model from calling every unlabelled text negative by heart.

The score adds up over a text's distinct words, so each word is scored once a task and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_WORD = re.compile(r"[^\W_]+")
#: Texts that the classifier is fitted on at most, of either kind, and characters of one of them at most.
MOST_POSITIVE, MOST_UNLABELLED, LONGEST = 3000, 6000, 20_000
BITS = 20
#: Words whose scores a task keeps.
KEPT_WORDS = 400_000


def features(word: str) -> list[int]:
    """Hashed features of a word, each once."""
    mask = (1 << BITS) - 1
    marked = f"^{word}$"
    raw = marked.encode()
    out = {crc32(raw) & mask}
    n = len(marked)
    for k in range(3, min(n, 8)):
        out.add(crc32(marked[:k].encode()) & mask)
    for k in (4, 6):
        for i in range(1, n - k):
            out.add(crc32(marked[i : i + k].encode()) & mask)
    return list(out)


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        known: dict[str, float] = {}
        w = self.weights

        def score(text: str | None) -> float:
            total = self.bias
            for word in distinct_words(text):
                v = known.get(word)
                if v is None:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    v = known[word] = float(w[features(word)].sum())
                total += v
            return total

        return score


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each text, and how many of its distinct words have each."""
    known: dict[str, list[int]] = {}
    for text in texts:
        all_: list[int] = []
        for word in distinct_words(text):
            f = known.get(word)
            if f is None:
                if len(known) >= KEPT_WORDS // 8:
                    known.clear()
                f = known[word] = features(word)
            all_ += f
        f, n = np.unique(np.array(all_, np.int32), return_counts=True)
        yield f, n


def fit(positive: list[str], unlabelled: list[str], prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """The classifier. Features that few positives have, or that are as common in unlabelled text, get no weight.
    Without positives, or without unlabelled text, every text scores the prior."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    n_p, n_u = len(positive), len(unlabelled)
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return Model(weights, bias)
    in_p, in_u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for texts, found in ((positive, in_p), (unlabelled, in_u)):
        for f, _ in _counted(texts):
            found[f] += 1
    p, u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    z = (p - u) / np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    used = np.flatnonzero((in_p + in_u >= 5) & (np.abs(z) >= 3.5))
    where = np.full(1 << BITS, -1, np.int32)
    where[used] = np.arange(len(used))
    parts = []
    for i, (f, many) in enumerate(_counted([*positive, *unlabelled])):
        keep = where[f] >= 0
        parts.append((np.full(keep.sum(), i, np.int32), where[f[keep]], many[keep].astype(np.float32)))
    row, col, val = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    n, sign = n_p + n_u, np.where(np.arange(n_p + n_u) < n_p, 1.0, 0.0)
    w, g2 = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-8)
    w[-1] = bias
    for _ in range(steps):
        m = np.bincount(row, w[col] * val, n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        soft = np.logaddexp(0, m)  # the loss of calling a text negative
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        to_p, to_n = np.where(sign, -prior / n_p * (1 - s), 0.0), np.where(sign, -prior / n_p * s, s / n_u)
        g = to_p + to_n if negative >= 0 else -to_n
        grad = np.append(np.bincount(col, g[row] * val, len(used)) + decay * w[:-1], g.sum())
        g2 += grad**2
        w -= rate * grad / np.sqrt(g2)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def sample(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The texts of up to most of these ids (column id, others stay), chosen by hash, that aren't too long to train on."""
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col("doc_id").alias("id"), "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "id")


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """docs: doc_id, text; labels: doc_id, y. held_out: an id column -> a boolean column; those rows train nothing.

    Of labels of one id that disagree the largest counts, and rows that repeat an id teach each. Without positives or
    without documents, every text scores the prior. Null ids and labels teach nothing; texts over LONGEST characters are
    scored whole but teach nothing."""
    known = labels.select(F.col("doc_id").alias("id"), "y").where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(~held_out(F.col("id")))
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    positive = known.where("y = 1").select("id", F.lit(1).alias("p"))
    rest = docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", F.lit(0).alias("p"))
    chosen = positive.orderBy(F.xxhash64("id"), "id").limit(MOST_POSITIVE).unionAll(rest.orderBy(F.xxhash64("id"), "id").limit(MOST_UNLABELLED))
    got = sample(docs, chosen, MOST_POSITIVE + MOST_UNLABELLED).select("id", "p", "text").toPandas().sort_values(["p", "id", "text"])
    return fit(list(got["text"][got["p"] == 1]), list(got["text"][got["p"] == 0]), float(prior))


def probability(spark: SparkSession, model: Model):
    """A function of a text column: the probability of being toxic. Null and empty texts score what the bias says."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for texts in frames:
            m = np.clip(np.array([one(t) for t in texts], float), -30, 30)
            yield pd.Series(1 / (1 + np.exp(-m)))

    return score


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), held_out)
    scored = docs.select("doc_id", probability(spark, model)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
