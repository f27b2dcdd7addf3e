"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression on sparse word 1- to 3-grams, fitted in numpy on notices that are made from templates
and on paragraphs of the corpus, names a paragraph's licence family or none. Its probabilities are calibrated by a
temperature on notices and paragraphs held back from the fit; what stays under LEAST_PROBABILITY is unknown. A named
family is confirmed by comparison with its templates: enough of one's word pairs must stand close together.

Paragraphs are lines; a line longer than a window is read in overlapping windows. Where a window speaks of a licence, the
classifier reads it as a whole and the words of each template that stands in it alone, so every family of a line is named.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table

#: Names and notices of public licences.
FAMILIES = {
    "MIT": (["MIT License", "MIT licence", "Expat License"], ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"], ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"]),
    "BSD": (["BSD License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License"], ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]),
    "GPL-2.0": (["GNU General Public License, version 2", "GPL version 2", "GPLv2", "GPL-2.0"], ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"]),
    "GPL-3.0": (["GNU General Public License, version 3", "GPL version 3", "GPLv3", "GPL-3.0"], ["under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"]),
    "LGPL": (["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL", "LGPLv2.1"], ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"]),
    "AGPL-3.0": (["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPLv3"], ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"]),
    "MPL-2.0": (["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0"], ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"]),
    "ISC": (["ISC License"], ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"]),
    "Unlicense": (["Unlicense"], ["This is free and unencumbered software released into the public domain"]),
    "CC0": (["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"], ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"]),
    "CC-BY": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"], []),
    "CC-BY-SA": (["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], []),
    "CC-BY-NC": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], []),
    "CC-BY-ND": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], []),
    "CC-BY-NC-SA": (["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"], []),
}
LEADS = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This software is distributed under the terms of the {}.", "This file is made available under the {}.", "The code is covered by the {}; see LICENSE for details.", "License: {}", "SPDX-License-Identifier: {}",
)
#: Talk of licences that names none.
NEUTRAL = (
    "All rights reserved.", "See the license for details.", "The license fee is due in March.", "A driving license is required.", "Copyright by the authors.", "The general public is welcome.", "Released under pressure.",
    "This work is under review.", "This software is sold under a commercial license.", "Version 2.0 of the report was released.", "The creative commons of the town.", "No license is granted by this notice.", "License plates of version 3.",
)
NONE = "none"
WINDOW, STEP = 60, 30
LEAST_PROBABILITY, LEAST_SIMILAR = 0.5, 0.6
#: Words over which a template's may be spread, as a multiple of its own.
SPREAD = 1.5
#: Documents whose paragraphs teach the class of no licence, at most, and paragraphs of them.
MOST_DOCUMENTS, MOST_PARAGRAPHS = 400, 3000


def grams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every 1- to 3-gram that lies in one text."""
    counts, n = np.diff(offsets), len(words)
    left = np.repeat(offsets[1:], counts) - np.arange(n)
    hashes, places = [tokens.mix(words)], [np.arange(n)]
    acc = words * tokens._STEP[0]
    for k in (1, 2):
        if n <= k:
            break
        acc = acc[:-1] + words[k:] * tokens._STEP[k]
        own = np.flatnonzero(left[: n - k] > k)
        hashes.append(tokens.mix(acc[own] + np.uint64(k)))
        places.append(own)
    return np.concatenate(hashes), np.concatenate(places)


def _pairs(text: str) -> set:
    words = tokens.words([text])[0].tolist()
    return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}


@dataclass
class Classifier:
    """Classes, the last of them NONE; sorted hashes of the n-grams that it knows, and their weights by class."""

    classes: list[str]
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def __post_init__(self):
        self.map = np.zeros(1 << 20, bool)
        self.map[self.keys >> np.uint64(44)] = True
        of_licences = self.weights[:, :-1].max(1) - self.weights[:, -1] if len(self.keys) else np.zeros(0)
        self.marks = of_licences > 0.3
        self.templates = [(c, _pairs(x)) for c, name in enumerate(self.classes[:-1]) for x in [*FAMILIES[name][0], *FAMILIES[name][1]]]
        self.holders: dict[tuple, list[int]] = {}
        for t, (_, pairs) in enumerate(self.templates):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(t)

    def known(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the n-gram, place) of those that it knows."""
        h, at = grams(words, offsets)
        some = self.map[h >> np.uint64(44)]
        h, at = h[some], at[some]
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = self.keys[k] == h
        return k[same], at[same]

    def probabilities(self, present: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[p].sum(0) for p in present]).reshape(len(present), -1) + self.bias
        z = np.exp((z - z.max(1, keepdims=True)) / self.heat)
        return z / z.sum(1, keepdims=True)

    def matches(self, words: list[int]) -> list[tuple]:
        """(class, similarity, places of the word pairs) of each template of which enough stands close together."""
        where: dict[int, list[tuple]] = {}
        for at in range(len(words)):
            for pair in ((words[at],), tuple(words[at : at + 2])):
                for t in self.holders.get(pair, ()) if at + len(pair) <= len(words) else ():
                    where.setdefault(t, []).append((at, pair))
        out = []
        for t, places in where.items():
            c, pairs = self.templates[t]
            best, reach = (0.0, 0, []), SPREAD * (len(pairs) + 1)
            for k, (start, _) in enumerate(places):
                if best[0] == 1 and best[1] == -len(pairs):
                    break
                firsts: dict[tuple, int] = {}
                for at, pair in places[k:]:
                    if at + len(pair) - start > reach:
                        break
                    firsts.setdefault(pair, at)
                held = [(at, at + len(pair)) for pair, at in firsts.items()]
                best = max(best, (len(held) / len(pairs), start - max(y for _, y in held), held), key=lambda x: x[:2])
            if best[0] >= LEAST_SIMILAR:
                out.append((c, best[0], best[2]))
        return out

    def families(self, words: np.ndarray, known: np.ndarray) -> dict[int, tuple[float, float]]:
        """{class: (probability, similarity)} of a window's licences; known: numbers of its n-grams."""
        whole = None
        found = []
        for c, near, held in self.matches(words.tolist()):
            if whole is None:
                whole = self.probabilities([known])[0]
                if whole[-1] > 1 - LEAST_PROBABILITY:
                    return {}
            of = np.zeros(len(words) + 2, np.int8)  # the template's own words, in runs
            for x, y in held:
                of[x + 1 : y + 1] = 1
            edge = np.diff(of)
            runs = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
            own = self.probabilities([np.unique(self.known(words[of[1:-1] == 1], np.concatenate([[0], np.cumsum(runs)]))[0])])[0]
            p = max(float(x[c]) if x.argmax() == c else 0.0 for x in (whole, own))
            if p >= LEAST_PROBABILITY:
                found.append((near, len(held), p, c, set(held)))
        out: dict[int, tuple[float, float]] = {}
        taken: set = set()
        for near, _, p, c, held in sorted(found, key=lambda x: (-x[0], -x[1], -x[2], x[3])):
            if c not in out and (near == 1 and held - taken or not held & taken):  # what lies in a better match is part of it
                out[c] = (p, near)
            if c in out:
                taken |= held
        return out

    def found(self, paragraphs: list[str]) -> list[tuple]:
        """(paragraph, family, probability, similarity, text) of each licence of each paragraph."""
        words, offsets = tokens.words(paragraphs)
        if not len(words) or not len(self.keys):
            return []
        k, at = self.known(words, offsets)
        order = np.argsort(at, kind="stable")
        k, at = k[order], at[order]
        line = np.searchsorted(offsets, at, "right") - 1
        out = []
        for i in np.unique(line[self.marks[k]]).tolist():
            mine = slice(*np.searchsorted(line, [i, i + 1]))
            own_k, own_at = k[mine], at[mine] - offsets[i]
            n = int(offsets[i + 1] - offsets[i])
            best: dict[int, tuple[float, float]] = {}
            for start in range(0, max(1, n - STEP), STEP):
                inside = own_k[slice(*np.searchsorted(own_at, [start, start + WINDOW]))]
                if self.marks[inside].any():
                    window = words[offsets[i] + start : min(offsets[i] + start + WINDOW, offsets[i + 1])]
                    for c, got in self.families(window, np.unique(inside)).items():
                        best[c] = max(best.get(c, got), got)
            out += [(i, self.classes[c], *got, paragraphs[i]) for c, got in sorted(best.items())]
        return out


def fit(plain: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> Classifier:
    """From the templates and plain paragraphs; of the latter, those that hold a whole template teach nothing."""
    classes = [*FAMILIES, NONE]
    rng = np.random.default_rng(seed)
    whole = [t for c in FAMILIES for x in FAMILIES[c][0] for t in [_pairs(x)] if len(next(iter(t))) > 1]
    texts, y = [], []
    for c, (names, notices) in enumerate(FAMILIES.values()):
        for text in [lead.format(n) for n in names for lead in LEADS] + [n + "." for n in names] + notices * 4:
            texts.append(text), y.append(c)
    for text in [*NEUTRAL * 4, *[p for p in plain if not any(t <= _pairs(p) for t in whole)]]:
        own = text.split()
        start = crc32(text.encode("utf-8", "replace")) % max(1, len(own) - WINDOW + 1)  # a window anywhere, as scans read them
        texts.append(" ".join(own[start : start + WINDOW])), y.append(len(classes) - 1)
    y = np.array(y)
    h, at = grams(*(wo := tokens.words(texts)))
    line = np.searchsorted(wo[1], at, "right") - 1
    of_notice = np.unique(h[y[line] < len(classes) - 1])
    keys = of_notice
    known = np.isin(h, keys)
    x = np.zeros((len(texts), len(keys)), np.float32)
    x[line[known], np.searchsorted(keys, h[known])] = 1
    out = rng.random(len(texts)) < 0.2
    share = np.bincount(y, minlength=len(classes))
    weight = (1 / np.maximum(share, 1))[y] * ~out
    weight[y == len(classes) - 1] *= 4
    weight /= weight.sum()
    w, b = np.zeros((len(keys), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    g2w, g2b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    target = np.eye(len(classes), dtype=np.float32)[y]

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for _ in range(steps):
        d = ((softmax(x @ w + b) - target) * weight[:, None]).astype(np.float32)
        gw, gb = x.T @ d + decay * w, d.sum(0)
        g2w += gw**2
        g2b += gb**2
        w -= rate * gw / np.sqrt(g2w)
        b -= rate * gb / np.sqrt(g2b)
    z = x[out] @ w + b
    heats = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), y[out]] + 1e-9).mean() for t in heats]
    return Classifier(classes, keys, w, b, heats[int(np.argmin(loss))])


def train(docs: DataFrame) -> Classifier:
    """docs: doc_id, text. Up to MOST_PARAGRAPHS different paragraphs of up to MOST_DOCUMENTS documents, all chosen by
    hash, teach what no licence is. Without documents, the templates and talk of licences alone teach."""
    ids = docs.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(MOST_DOCUMENTS)
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.length("text") <= 20_000).join(F.broadcast(ids), "id")
    every = {p for (t,) in rows.select("text").collect() for p in t.split("\n") if p.strip()}
    return fit(sorted(every, key=lambda p: (crc32(p.encode("utf-8", "replace")), p))[:MOST_PARAGRAPHS])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph, licence, probability, similarity, notice: one row for each licence of each paragraph. Null
    and empty texts have none, an empty table gives an empty table, texts of any length are read whole. Rows that repeat give a row each. Other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<paragraph: int, licence: string, probability: double, similarity: double, notice: string>>")
    def found(text: pd.Series) -> pd.Series:
        texts = list(text)
        out: list[list] = [[] for _ in texts]
        for a, b in tokens.batches(texts):
            lines, of = [], []
            for i in range(a, b):
                for k, p in enumerate(texts[i].split("\n")):
                    lines.append(p), of.append((i, k))
            for j, *rest in held.value.found(lines):
                i, k = of[j]
                out[i].append((k, *rest))
        return pd.Series(out)

    return rows.select(F.col("id").alias(id_col), F.inline(found("text")))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).select("doc_id", "paragraph", "licence", "probability", "similarity")
