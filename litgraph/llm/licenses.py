"""Licence scans: a trained paragraph classifier whose findings a template has to confirm.

A paragraph is a line, or a window of ``PARAGRAPH_WORDS`` words of a longer one. Windows start every ``STRIDE`` words, so
that any notice as long as the longest template lies whole in one, and at each multiple of their length; in such a line
also windows of the ``SHORT`` lengths, as a short notice weighs little among 48 words. Its features are its words and word pairs, hashed, at
length 1. A multinomial logistic regression gives the probabilities of each licence family and of the unknown class.
It is trained here: the families from their templates with words left out, put in, cut off and set among other words,
the unknown class from paragraphs of the corpus (a bounded sample, ``MAX_UNKNOWN``, of least hash) that no template is
like, and from mixed licence words in no order. A temperature fitted on rows left out calibrates the probabilities.

A finding is a paragraph whose likeliest class is a family with at least ``LEAST`` probability. It is confirmed if the
family's nearest template shares enough word pairs with it: at least ``CONFIRM`` of the smaller set of the two. Of
windows of one family that overlap, the surest stands for the others, confirmed ones first.

Cases: null and empty texts have no paragraph and no finding. Texts of any length are scanned whole. Repeated rows are
scanned each. Ties of probability go to the family first in the table. An empty corpus trains the unknown class from
mixed words only. Other columns pass through; one named like the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices

# Fixed: wording of public licences and of their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license, see the LICENSE file.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "to deal in the Software without restriction"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE 2.0",
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation, either version 3 of the License, or any later version",
            "Licensed under the GNU GPL version 2."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Licensed under the ISC License."),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "all-rights-reserved": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.",
                            "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
UNKNOWN = "unknown"
PARAGRAPH_WORDS, STRIDE = 48, 8  # the longest template has 48 - 8 + 1 words at most
SHORT = (16, 24)  # multiples of STRIDE
FEATURES = 1 << 14
COPIES = 30
MAX_UNKNOWN = 4000
LEAST, CONFIRM = 0.5, 0.6
WORD = re.compile(r"[^\W_]+")


def spoken(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashed(words: list[str]) -> np.ndarray:
    """Features of a paragraph: its words and pairs, hashed, each once a time it occurs."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return np.concatenate([h, pairs_of(h)]) % np.uint64(FEATURES)


def pairs_of(h: np.ndarray) -> np.ndarray:
    return mix64(h[:-1] * np.uint64(3) + h[1:])


def likeness(words: list[str], family: str) -> float:
    """Share of the smaller set of word pairs that the paragraph and the family's nearest template have in common."""
    own, best = set(zip(words, words[1:], strict=False)), 0.0
    for t in TEMPLATES[family]:
        w = spoken(t)
        other = set(zip(w, w[1:], strict=False))
        if own and other:
            best = max(best, len(own & other) / min(len(own), len(other)))
    return best


@dataclass
class Model:
    weights: np.ndarray  # (FEATURES, classes)
    bias: np.ndarray
    temperature: float

    @property
    def names(self) -> list[str]:
        return [*TEMPLATES, UNKNOWN]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def examples(unknown: list[list[str]], seed: int = 9) -> tuple[list[list[str]], np.ndarray]:
    """Training paragraphs as words, and their classes."""
    rng = np.random.default_rng(seed)
    pool = [w for p in unknown for w in p] or ["x"]
    rows, classes, every = [], [], []

    def some(n: int) -> list[str]:
        return [pool[i] for i in rng.integers(0, len(pool), n)]

    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            words = spoken(t)
            every += words
            for i in range(COPIES):
                w = list(words)
                if i and len(w) > 6 and rng.random() < 0.5:
                    a = int(rng.integers(0, len(w) // 3 + 1))
                    w = w[a:a + max(6, int(len(w) * rng.uniform(0.5, 1)))]
                if i and len(w) > 4:
                    w = [x for x in w if rng.random() > 0.06]
                if i % 3 == 1:
                    w = [*some(int(rng.integers(0, 12))), *w, *some(int(rng.integers(0, 20)))]
                rows.append(w)
                classes.append(k)
    mixed = [[every[i] for i in rng.integers(0, len(every), int(rng.integers(2, 12)))] + some(int(rng.integers(4, 20))) for _ in range(len(rows) // 4)]
    other = [p for p in unknown if max(likeness(p, f) for f in TEMPLATES) < 0.5] + mixed
    return rows + other, np.array(classes + [len(TEMPLATES)] * len(other))


def fit(unknown: list[list[str]], steps: int = 150, seed: int = 9) -> Model:
    """Full-batch training with adaptive steps; every fifth row is left out for the temperature."""
    rows, y = examples(unknown, seed)
    feats = [hashed(r).astype(np.int64) for r in rows]
    ok = [i for i, f in enumerate(feats) if len(f)]
    feats, y = [feats[i] for i in ok], y[ok]
    size = np.array([len(f) for f in feats])
    col, row = np.concatenate(feats), np.repeat(np.arange(len(feats)), size)
    used, col = np.unique(col, return_inverse=True)
    value = (1 / np.sqrt(size))[row]
    n, k = len(feats), len(TEMPLATES) + 1
    start = np.cumsum(size) - size
    order = np.argsort(col, kind="stable")
    col_start = np.searchsorted(col[order], np.arange(len(used)))
    train = np.arange(n) % 5 != 0
    share = np.bincount(y[train], minlength=k)
    weight = np.where(train, 1 / np.maximum(share, 1)[y], 0.0)
    weight[y == k - 1] *= 4
    weight /= weight.sum()
    w, b, seen, seen_b = np.zeros((len(used), k)), np.zeros(k), 0.0, 0.0
    for _ in range(steps):
        z = np.add.reduceat(w[col] * value[:, None], start) + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None]
        g = np.add.reduceat((p[row] * value[:, None])[order], col_start) + 1e-6 * w
        seen, seen_b = seen + g * g, seen_b + p.sum(0) ** 2
        w -= 0.5 * g / np.sqrt(seen + 1e-10)
        b -= 0.5 * p.sum(0) / np.sqrt(seen_b + 1e-10)
    logits = (np.add.reduceat(w[col] * value[:, None], start) + b)[~train]
    full = np.zeros((FEATURES, k), np.float32)
    full[used] = w

    def loss(t: float) -> float:
        p = Model(full, b, t).probabilities(logits)
        return -np.log(np.maximum(p[np.arange(len(p)), y[~train]], 1e-12)).mean()

    return Model(full, b.astype(np.float32), float(min(np.geomspace(0.5, 8, 25), key=loss)))


def paragraphs(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Lines of all texts with a word, and the text of each."""
    lines, of = [], []
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if line:
                lines.append(line)
                of.append(i)
    return lines, np.array(of, np.int64)


def findings(model: Model, texts: list[str | None]) -> list[list[dict]]:
    """For each text the paragraphs that are of a family: where, which, how sure, and whether a template agrees."""
    lines, of = paragraphs(texts)
    out: list[list[dict]] = [[] for _ in texts]
    if not lines:
        return out
    clean = pc.replace_substring_regex(pc.utf8_lower(pa.array(lines, pa.large_string())), r"[^\p{L}\p{N}]+", " ")
    runs = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(clean))
    coded = runs.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[which]
    first = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    length = np.diff(first)
    blocks = -(-length // STRIDE)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    line = np.repeat(np.arange(len(length)), blocks)
    offset = (np.arange(len(line)) - block_at[line]) * STRIDE
    weights = model.weights[(h % np.uint64(FEATURES)).astype(np.int64)]
    pair = np.vstack([model.weights[(pairs_of(h) % np.uint64(FEATURES)).astype(np.int64)], np.zeros((1, weights.shape[1]), np.float32)])
    pair[first[1:] - 1] = 0  # no pair over a line's end
    sums = np.add.reduceat(weights + pair, first[line] + offset)
    # windows up to the first that reaches the line's end, and those at multiples of their length
    used = np.flatnonzero((offset - STRIDE + PARAGRAPH_WORDS < length[line]) & (offset > 0) | (offset % PARAGRAPH_WORDS == 0))
    width = np.full(len(used), PARAGRAPH_WORDS)
    for w in SHORT:
        more = np.flatnonzero((length[line] > PARAGRAPH_WORDS) & ((offset - STRIDE + w < length[line]) | (offset == 0)))
        used, width = np.append(used, more), np.append(width, np.full(len(more), w))
    line, offset = line[used], offset[used]
    size = np.minimum(length[line] - offset, width)
    begin = first[line] + offset
    total = np.zeros((len(used), weights.shape[1]), np.float32)
    for k in range(PARAGRAPH_WORDS // STRIDE):
        inside = (used + k < block_at[line + 1]) & (k * STRIDE < width)
        total[inside] += sums[used[inside] + k]
    total -= pair[begin + size - 1]  # no pair over a window's end
    logits = total / np.sqrt(2 * size - 1)[:, None] + model.bias
    top = logits.argmax(1)
    seen: dict[tuple[int, str], list[tuple]] = {}
    for i in np.flatnonzero(top < len(TEMPLATES)).tolist():
        p = float(model.probabilities(logits[i:i + 1])[0, top[i]])
        words = [names[w] for w in which[begin[i]:begin[i] + size[i]].tolist()]
        if p < LEAST or words == [""]:
            continue
        family = model.names[top[i]]
        like = likeness(words, family)
        seen.setdefault((int(line[i]), family), []).append((like < CONFIRM, -p, int(offset[i]), int(size[i]), like))
    kept = []
    for (at, family), windows in seen.items():
        chosen: list[tuple] = []
        for w in sorted(windows):
            if all(w[2] >= o + n or o >= w[2] + w[3] for _, _, o, n, _ in chosen):
                chosen.append(w)
        kept += [(at, o, family, -p, like, not unsure) for unsure, p, o, _, like in chosen]
    for at, _, family, p, like, sure in sorted(kept):
        out[of[at]].append({"paragraph": at, "family": family, "probability": p, "likeness": like, "confirmed": sure})
    starts = np.searchsorted(of, np.arange(len(texts)))
    for i, found in enumerate(out):
        for f in found:
            f["paragraph"] -= int(starts[i])
    return out


FOUND = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
                                  T.StructField("likeness", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]))
ARROW_FOUND = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_UNKNOWN) -> Model:
    """A model whose unknown class comes from the corpus: one paragraph each, chosen by hash, of ``most`` documents."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"\w"))
    # the documents of least hash: of those with a line, about four times as many as are wanted pass the bound to the sort
    hashed = docs.select(F.xxhash64(doc_id).alias("_h"), F.col(doc_id).alias("_id"), F.col(text).alias(text))
    n = hashed.where(F.col(text).rlike(r"\w")).count()
    bound = int(min(1.0, 4 * most / max(1, n)) * (1 << 64)) - (1 << 63) - 1
    chosen = (hashed.where(F.col("_h") <= bound).select("_h", "_id", lines.alias("_lines")).where("size(_lines) > 0")
              .select("_h", "_id", F.element_at("_lines", (F.pmod("_h", F.size("_lines")) + 1).cast("int")).alias("line"))
              .orderBy("_h", "_id", "line").limit(most))
    got = [spoken(r["line"])[:PARAGRAPH_WORDS] for r in chosen.select("line").collect()]
    return fit([g for g in got if g])


def scan(docs: DataFrame, model: Model, text: str = "text", found: str = "licenses") -> DataFrame:
    """``docs`` with the array ``found``: paragraph number, family, probability, likeness, confirmed."""
    keep = [f for f in docs.schema.fields if f.name != found]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(findings(model, texts), ARROW_FOUND)], [*names, found])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(found, FOUND)]))
