"""Quality by a byte-level convolutional network, in numpy.

A text's bytes are embedded, with one channel that says whether the four bytes here also stood a few bytes before;
learned filters run over overlapping windows of the whole text, in chunks that overlap by a window, so that no window
is lost between them. Each chunk is max-pooled; the largest and the mean of a text's chunks make one probability.
The maximum passes gradients to one window a chunk and filter, so training costs little more than scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH, STRIDE, CHUNK, EMBED, FILTERS = 8, 2, 256, 7, 24
#: How far back the repeat channel looks.
LAGS = range(2, 29)
#: Labelled texts that the network is fitted on at most, and bytes of one of them at most.
MOST_LABELLED, LONGEST = 4000, 20_000
#: Chunks of a product.
_BLOCK = 64
#: Bytes that are held as arrays at once; pooling goes on from one part of a longer text to the next.
PART = 1 << 20


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float

    @staticmethod
    def fresh(seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        f = rng.normal(0, 1 / np.sqrt(WIDTH * (EMBED + 1)), (WIDTH * (EMBED + 1), FILTERS))
        return Net(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), f.astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(one buffer, first chunk of each text): a text fills whole chunks and ends in at least WIDTH zeros."""
    chunks = np.array([(len(t) + WIDTH + CHUNK - 1) // CHUNK for t in texts])
    first = np.concatenate([[0], np.cumsum(chunks)])
    buf = np.zeros(first[-1] * CHUNK + WIDTH, np.uint8)
    for t, at in zip(texts, first, strict=False):
        if t:
            buf[at * CHUNK : at * CHUNK + len(t)] = np.frombuffer(t, np.uint8)
    return buf, first


def repeats(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here also stand from one of LAGS bytes before in the same text, padding left out.
    first: first chunk of each text."""
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    g = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    hit = np.zeros(len(g), bool)
    starts = first[:-1] * CHUNK
    for lag in LAGS:
        same = g[lag:] == g[:-lag]
        same[(starts[1:, None] + np.arange(-lag, 0))] = False  # from here back lies the text before
        hit[lag:] |= same
    return (hit & (buf > 0)).astype(np.float32)


def pooled(net: Net, buf: np.ndarray, first: np.ndarray, trace: bool = False):
    """(chunks, FILTERS) maxima over a chunk's windows; with trace the windows where they are. A chunk's maxima are the
    same bits whatever stands around its text: every product has the same shape."""
    n = (len(buf) - WIDTH) // CHUNK
    per = CHUNK // STRIDE
    tops, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if trace else None
    again = repeats(buf, first)
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = True
    x = np.zeros((_BLOCK * CHUNK + WIDTH, EMBED + 1), np.float32)
    flat = np.lib.stride_tricks.as_strided(x, (_BLOCK * per, WIDTH * (EMBED + 1)), (x.strides[0] * STRIDE, 4))
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        piece = slice(at * CHUNK, to * CHUNK + WIDTH)
        x[: piece.stop - piece.start, :EMBED] = net.embed[buf[piece]]
        x[: piece.stop - piece.start, EMBED] = again[piece]
        y = (np.ascontiguousarray(flat) @ net.filters).reshape(_BLOCK, per, FILTERS)[: to - at]
        y[ends[at:to], per - WIDTH // STRIDE + 1 :] = -np.inf  # of padding only, and of the next text's first bytes
        if trace:
            where[at:to] = y.argmax(1)
        tops[at:to] = y.max(1)
    tops = np.maximum(tops + net.shift, 0)
    return (tops, where, again) if trace else tops


def combined(net: Net, tops: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and what they are made of: each text's largest and mean chunk."""
    most = np.maximum.reduceat(tops, first[:-1])
    mean = np.add.reduceat(tops, first[:-1]) / np.diff(first)[:, None]
    both = np.hstack([most, mean])
    return (both * net.out).sum(1) + net.bias, both  # row by row: a product's bits could depend on its number of rows


def score_texts(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probabilities, in parts of bounded size; a text longer than a part is pooled part by part."""
    out = np.empty(len(texts))
    start = 0
    while start < len(texts):
        if len(texts[start]) > PART:
            whole = texts[start]
            tops = []
            for at in range(0, len(whole), PART):  # each with the chunk before it, which the repeat channel looks back to
                ahead = min(at, CHUNK)
                part = pooled(net, *laid_out([whole[at - ahead : at + PART + WIDTH]]))[ahead // CHUNK :]
                tops.append(part[: PART // CHUNK] if at + PART < len(whole) else part)
            tops = np.concatenate(tops)
            out[start] = combined(net, tops, np.array([0, len(tops)]))[0][0]
            start += 1
            continue
        end, held = start, 0
        while end < len(texts) and held + len(texts[end]) <= PART and len(texts[end]) <= PART:
            held += len(texts[end]) + CHUNK
            end += 1
        end = max(end, start + 1)
        buf, first = laid_out(texts[start:end])
        out[start:end] = combined(net, pooled(net, buf, first), first)[0]
        start = end
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Net:
    """The network, by Adam on the logistic loss. Without both labels, every text scores the labels' mean."""
    net = Net.fresh(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    net.bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    rng = np.random.default_rng(seed)
    params = [net.embed, net.filters, net.shift, net.out, np.array([net.bias], np.float32)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            buf, first = laid_out([texts[i] for i in chosen])
            tops, where, again = pooled(net, buf, first, trace=True)
            logit, both = combined(net, tops, first)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[chosen]) / len(chosen)
            g_both = g[:, None] * net.out
            chunks = np.diff(first)
            of = np.repeat(np.arange(len(chosen)), chunks)
            g_tops = g_both[of, FILTERS:] / chunks[of][:, None]
            most = both[:, :FILTERS][of] == tops
            g_tops = g_tops + g_both[of, :FILTERS] * most / np.maximum(1, np.add.reduceat(most, first[:-1])[of])
            g_tops = np.where(tops > 0, g_tops, 0).astype(np.float32)
            starts = np.arange(len(tops))[:, None] * CHUNK + where * STRIDE
            inside = starts[:, :, None] + np.arange(WIDTH)
            seen = buf[inside]
            x = np.concatenate([net.embed[seen], again[inside][..., None]], -1).reshape(len(tops), FILTERS, -1)
            g_filters = np.einsum("cf,cfk->kf", g_tops, x)
            g_x = (g_tops[:, :, None] * net.filters.T[None]).reshape(len(tops), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
            g_embed = np.stack([np.bincount(seen.ravel(), g_x[..., e].ravel(), 256) for e in range(EMBED)], 1)
            grads = [g_embed, g_filters + decay * net.filters, g_tops.sum(0), both.T @ g + decay * net.out, np.array([g.sum()])]
            step += 1
            lr = rate * (1 - step / (total + 1))
            for p, d, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            net.bias = float(params[4][0])
    return net


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def train(docs: DataFrame, labels: DataFrame, held_out) -> Net:
    """docs: doc_id, text; labels: doc_id, y. held_out: an id column -> a boolean column; those rows train nothing.
    Fits on up to MOST_LABELLED labelled texts, chosen by hash; of labels of one id that disagree the largest counts, and
    rows that repeat an id teach each. Empty tables, and labels of one kind only, give a network that scores every text
    the labels' mean, or 0.5 without any. Null ids and labels teach nothing."""
    known = labels.select(F.col("doc_id").alias("id"), "y").where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "id")
    got = rows.toPandas().sort_values(["id", "text"])
    return fit([_bytes(t) for t in got["text"]], got["y"].to_numpy(float))


def probability(spark: SparkSession, net: Net):
    """A function of a text column: the probability of label 1. A null text is empty and scores like one."""
    held = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(held.value, [_bytes(t) for t in text]))

    return score


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), held_out)
    scored = docs.select("doc_id", probability(spark, net)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
