"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over hashed word n-grams (one to three words)
gives each paragraph a licence family or ``none``. It is fitted here, on
variants of the templates below (words dropped, changed, put into prose) and on
paragraphs of the corpus without licence vocabulary as the ``none`` class. A
temperature, the least probability of a family and that of a notice of whatever
family are calibrated on variants that the fit has not seen; what is a notice,
but of no sure family, is ``unknown``. A predicted family, and no other, is
confirmed by aligning the paragraph with the family's templates: a stretch of
its words has to be within a quarter of a template's words in edits, with every
number of the template in it, and for short templates every word that no other
family has.

Paragraphs are single lines, and stretches of 16, 32 and 64 words of the runs of
lines between blank ones, so that a notice is found whether it stands on a line
of its own, is wrapped over lines, or is part of a longer paragraph. The
classifier sees all of them: words, n-grams and sums of weights are numpy arrays
over all words of a batch, and a stretch's score is the difference of two sums.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes, text_udf
from .decontaminate import best_stretch

# Short notices of public licences, by family.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Released under the zlib License."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
)

NONE, UNKNOWN = "none", "unknown"
FAMILIES = (NONE, *sorted({f for f, _ in TEMPLATES}))
BUCKETS = 1 << 14
#: Variants of each template in the fit and in the calibration.
VARIANTS, CALIBRATION = 24, 12
#: Defaults of ``train``'s bounds: documents and paragraphs of the corpus that class none is learned from.
NONE_DOCS, NONE_ROWS = 300, 3_000
#: Paragraphs of class none made of the templates' own words, and as many of words that nobody knows.
SHUFFLED = 800
EPOCHS, BATCH, RATE, DECAY = 8, 128, 4.0, 1e-4
#: Share of true families that the unknown class may take, and of paragraphs of class none that may be called notices, in the calibration.
MISSED, FALSE = 0.02, 0.01
#: An n-gram counts once among so many neighbours.
NEAR = 8
#: Words of the stretches of longer paragraphs; they begin every quarter of that.
STRETCHES = (16, 32, 64)
#: A confirmed paragraph is within this share of a template's words in edits.
EDITS = 0.25
#: Templates of at most this many words are confirmed only with all words that no other family has.
SHORT = 12
#: Bytes of text whose words are scored at once.
RUN_BYTES = 1 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = 1
_CLASS[[*b".-"]] = 2  # part of a word between its other characters
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64) for k in range(1 << 10)], np.uint64)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, and where it begins."""
    raw = np.frombuffer(text.lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    inner = np.zeros(len(raw) + 2, bool)
    inner[1:-1] = kind == 1
    word = inner[1:-1] | ((kind == 2) & inner[:-2] & inner[2:])
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(word)
    first = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    return _mix(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023], first)), starts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int, line: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the n-grams that begin at each word but the last n - 1; bucket 0 stands for all that repeat one of the ``NEAR`` before, in the same ``line``."""
    key = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    bucket = ((key >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    for k in range(1, min(NEAR, len(key) - 1) + 1):
        same = key[k:] == key[:-k]
        if line is not None:
            same &= line[k : len(key)] == line[: len(key) - k]
        bucket[k:][same] = 0
    return bucket


def row_of(words: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of one paragraph."""
    return np.concatenate([grams(words, n) for n in (1, 2, 3)])


def _templates() -> list[tuple[int, list[int], frozenset[int], frozenset[int]]]:
    """Of every template its class, its words, the numbers among them, and those that no other family has."""
    split = [(FAMILIES.index(family), text.lower().encode()) for family, text in TEMPLATES]
    of: dict[int, set[int]] = {}
    for family, raw in split:
        for w in word_hashes(raw)[0].tolist():
            of.setdefault(w, set()).add(family)
    out = []
    for family, raw in split:
        hashes, starts = word_hashes(raw)
        words = hashes.tolist()
        numbers = frozenset(w for w, s in zip(words, starts.tolist()) if raw[s : s + 1].isdigit())
        out.append((family, words, numbers, frozenset(w for w in words if len(of[w]) == 1)))
    return out


_SPLIT = _templates()
_VOCABULARY = frozenset(w for _, words, _, _ in _SPLIT for w in words)
#: Per class its templates, and the words without which nothing is confirmed.
_ALIGNED = {f: [(words, numbers | own if len(words) <= SHORT else numbers) for g, words, numbers, own in _SPLIT if g == f] for f in range(1, len(FAMILIES))}


def variants(n: int, seed: int, prose: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(class, words) of ``n`` changed copies of every template."""
    rng = random.Random(seed)
    filler = np.concatenate([*prose, np.ones(1, np.uint64)]).tolist()
    out = []
    for family, words, numbers, own in _SPLIT:
        for k in range(n):
            w = list(words)
            if k:  # what tells the family from others stays
                w = [x for x in w if x in numbers or x in own or rng.random() > 0.06 * (k % 3)]
                at = rng.randrange(len(w))
                if k % 4 == 1 and w[at] not in numbers | own:
                    w[at] = rng.choice(filler)
                if k % 2:  # as much prose as a line or a stretch has around a notice
                    most = min(12, 2 * len(words))
                    w = [rng.choice(filler) for _ in range(rng.randrange(most))] + w + [rng.choice(filler) for _ in range(rng.randrange(most))]
            out.append((family, np.array(w, np.uint64)))
    return out


def shuffled(n: int, seed: int, prose: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Class none though their words are the templates': a few of them out of order, among prose."""
    rng = random.Random(seed)
    pool = [w for _, words, _, _ in _SPLIT for w in words]
    filler = np.concatenate([*prose, np.ones(1, np.uint64)]).tolist()
    out = []
    for _ in range(n):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 12))] + [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        rng.shuffle(words)
        out.append((0, np.array(words, np.uint64)))
    return out


def unknown_words(n: int, seed: int, prose: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Class none: runs of one to 40 words without meaning, a third of them one word over and over, and short pieces of prose."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        size = int(rng.integers(1, 41))
        words = rng.integers(1, 1 << 63, 1 if k % 3 == 0 else size, dtype=np.uint64)
        if k % 3 == 1 and prose:
            piece = prose[int(rng.integers(len(prose)))]
            words = piece[: 1 + size % 6]
        out.append((0, np.resize(words, size) if k % 3 == 0 else words))
    return out


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS + 1 by classes; the last row is the intercept
    temperature: float = 1.0
    least: float = 0.0  # families below this probability are unknown
    notice: float = 0.5  # paragraphs whose families have less than this together are none

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of sparse rows of buckets; their sums of weights are scaled by the root of their number."""
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((len(rows), len(FAMILIES)))
        some = sizes > 0
        if some.any():
            flat = self.weights[np.concatenate(rows)]
            out[some] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[some])
        return self.softmax(out, sizes)

    def softmax(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        z = (sums / np.sqrt(np.maximum(sizes, 1))[:, None] + self.weights[-1]) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(prose: Iterable[bytes], seed: int = 5) -> Model:
    """Trains on template variants and on paragraphs of class none, in batches, each weight in steps by its own gradients so far."""
    none = [w for w in (word_hashes(p)[0] for p in prose) if len(w)]
    run = np.concatenate(none) if none else np.zeros(0, np.uint64)
    stretches = [run[a : a + n] for n in STRETCHES for a in range(0, max(len(run) - n, 0), max(n, len(run) // 400))]
    plain = none + stretches
    train = variants(VARIANTS, seed, none) + shuffled(SHUFFLED, seed, none) + unknown_words(SHUFFLED, seed, none) + [(0, w) for w in plain[::2]]
    held = variants(CALIBRATION, seed + 1, none[1::2]) + shuffled(SHUFFLED // 4, seed + 1, none) + unknown_words(SHUFFLED, seed + 1, none) + [(0, w) for w in plain[1::2]]
    rng = np.random.default_rng(seed)
    train = [train[k] for k in rng.permutation(len(train))]
    rows = [row_of(w) for _, w in train]
    used, place = np.unique(np.concatenate(rows), return_inverse=True)
    weights, bias = np.zeros((len(used), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    power, power_bias = np.full(weights.shape, 1e-6, np.float32), np.full(bias.shape, 1e-6, np.float32)
    batches, at = [], 0
    for k in range(0, len(rows), BATCH):
        sizes = np.array([len(r) for r in rows[k : k + BATCH]])
        flat, row = place[at : at + sizes.sum()], np.repeat(np.arange(len(sizes)), sizes)
        at += sizes.sum()
        order = np.argsort(flat, kind="stable")
        mine, first = np.unique(flat[order], return_index=True)
        truth = np.array([c for c, _ in train[k : k + BATCH]])
        batches.append((flat, np.cumsum(sizes) - sizes, (1 / np.sqrt(sizes))[:, None].astype(np.float32), row[order], mine, first, truth))
    for _ in range(EPOCHS):
        for flat, starts, scale, by_bucket, mine, first, truth in batches:
            z = np.add.reduceat(weights[flat], starts) * scale + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(truth)), truth] -= 1
            grad = np.add.reduceat((p * scale)[by_bucket], first) + DECAY * weights[mine]
            power[mine] += grad * grad
            weights[mine] -= RATE * grad / np.sqrt(power[mine])
            grad = p.sum(axis=0)
            power_bias += grad * grad
            bias -= RATE / 4 * grad / np.sqrt(power_bias)
    full = np.zeros((BUCKETS + 1, len(FAMILIES)))
    full[used], full[-1] = weights, bias
    model = Model(full)
    truth = np.array([c for c, _ in held])
    rows = [row_of(w) for _, w in held]

    def loss(t: float) -> float:
        model.temperature = t
        return -float(np.log(np.maximum(model.probabilities(rows)[np.arange(len(truth)), truth], 1e-12)).mean())

    model.temperature = min((loss(t), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0))[1]
    p = model.probabilities(rows)
    model.notice = max(0.5, float(np.quantile(1 - p[truth == 0, 0], 1 - FALSE)))
    seen = (truth > 0) & (1 - p[:, 0] >= model.notice)
    model.least = float(np.quantile(p[np.arange(len(truth)), truth][seen], MISSED)) if seen.any() else 0.5
    return model


def confirm(words: list[int], family: int) -> tuple[int, int] | None:
    """The stretch of ``words`` that a template of the family aligns with, the closest by share of its words; None if none does."""
    best = None
    for template, needed in _ALIGNED[family]:
        most = int(EDITS * len(template))
        got = best_stretch(template, words, most)
        if got:
            start = max(0, got[1] - len(template) - got[0])
            if needed <= set(words[start : got[1]]) and (best is None or got[0] / len(template) < best[0]):
                best = (got[0] / len(template), start, got[1])
    return best and best[1:]


def _units(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words and ends of lines and stretches, and the same of the runs of lines that hold them."""
    new = np.concatenate([[True], np.diff(line) > 0])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(line))
    gap = np.concatenate([[True], np.diff(line) > 1])
    run_a = np.flatnonzero(gap)
    run_b = np.append(run_a[1:], len(line))
    firsts, ends = [a], [b]
    several = line[run_b - 1] > line[run_a]
    for n in STRETCHES:
        long = (several | (run_b - run_a > n)) & (run_b - run_a > 1)
        x, y = run_a[long], run_b[long]
        step = n // 4
        times = np.maximum(-(-(y - x - n) // step), 0) + 1
        s = np.repeat(x, times) + step * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        firsts.append(s)
        ends.append(np.minimum(s + n, np.repeat(y, times)))
    a, b = np.concatenate(firsts), np.concatenate(ends)
    at = np.searchsorted(run_a, a, side="right") - 1
    return a, b, run_a[at], run_b[at]


#: Words whose weights are summed at once.
_BLOCK = 1 << 15


def _sums(model: Model, words: np.ndarray, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the weights of all n-grams within the stretches a..b."""
    classes = len(FAMILIES)
    weights = model.weights.astype(np.float32)
    zero = np.zeros((1, classes), np.float32)
    keys = [np.concatenate([grams(words, n, line), np.full(min(n - 1, len(words)), BUCKETS + 1)]) for n in (1, 2, 3)]
    padded = np.concatenate([weights, zero])  # row BUCKETS + 1: n-grams beyond the end
    low, high = np.zeros((len(a), classes)), np.zeros((len(a), classes))
    carry = np.zeros(classes)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    for s in range(0, len(words), _BLOCK):
        e = min(s + _BLOCK, len(words))
        each = padded[keys[0][s:e]] + padded[keys[1][s:e]] + padded[keys[2][s:e]]
        sums = np.concatenate([carry[None], carry + np.cumsum(each, axis=0, dtype=np.float64)])
        for where, order, out, last in ((a, by_a, low, e - 1), (b, by_b, high, e)):
            # a stretch begins at a word of the block and ends after one
            first = s if where is a else s + 1
            i = order[np.searchsorted(where[order], first) : np.searchsorted(where[order], last, side="right")]
            out[i] = sums[where[i] - s]
        carry = sums[-1]
    out = high - low
    # n-grams that reach beyond the stretch
    out -= padded[keys[1][b - 1]]
    out -= padded[keys[2][b - 1]]
    two = b - a > 1
    out[two] -= padded[keys[2][b[two] - 2]]
    return out


def scan_paragraphs(model: Model, texts: list[bytes]) -> list[list[dict]]:
    """Per text its notices: line and last line (from 0), family, probability, confirmed."""
    out: list[list[dict]] = [[] for _ in texts]
    joined = b"\n\n".join(texts)
    words, starts = word_hashes(joined)
    if not len(words):
        return out
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    first_line = np.searchsorted(breaks, begin)
    a, b, low, high = _units(line)
    n = b - a
    p = model.softmax(_sums(model, words, line, a, b), n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0))
    family = p.argmax(axis=1)
    hit = np.flatnonzero(1 - p[:, 0] >= model.notice)
    family[hit] = 1 + p[hit, 1:].argmax(axis=1)
    doc = np.searchsorted(begin, starts[a[hit]], side="right") - 1
    by_doc: dict[int, list[int]] = {}
    for d, k in zip(doc.tolist(), hit.tolist()):
        by_doc.setdefault(d, []).append(k)
    for d, units in by_doc.items():
        taken: list[tuple[int, int]] = []
        found, open_ = [], []
        free = lambda x, y: all(y <= s or e <= x for s, e in taken)
        for k in sorted(units, key=lambda k: (-float(p[k, family[k]]), k)):
            x, y = int(a[k]), int(b[k])
            if not free(x, y):
                continue
            x0, y0 = max(int(low[k]), x - 4), min(int(high[k]), y + 4)
            got = confirm(words[x0:y0].tolist(), int(family[k])) if p[k, family[k]] >= model.least else None
            if got is None:
                if len(_VOCABULARY.intersection(words[x:y].tolist())) > 1:  # else other words fell into the templates' buckets
                    open_.append((x, y, k))
            elif free(x0 + got[0], x0 + got[1]):
                taken.append((x0 + got[0], x0 + got[1]))
                found.append((x0 + got[0], x0 + got[1], FAMILIES[family[k]], float(p[k, family[k]]), True))
        for x, y, k in open_:
            if free(x, y):
                taken.append((x, y))
                found.append((x, y, UNKNOWN, float(p[k, family[k]]), False))
        for x, y, name, sure, confirmed in sorted(found):
            out[d].append({"line": int(line[x] - first_line[d]), "last_line": int(line[y - 1] - first_line[d]), "family": name, "probability": sure, "confirmed": confirmed})
    return out


def train(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", none_docs: int = NONE_DOCS, none_rows: int = NONE_ROWS) -> Model:
    """Fits with lines of a bounded sample of documents as class none: at most ``none_rows`` lines of the ``none_docs`` documents whose ids hash lowest.

    Only the ids are read to choose the documents; lines that speak of licences,
    copyright or permission aren't taken.
    """
    h = F.xxhash64(doc_id)
    last = docs.select(h.alias("h")).orderBy("h").limit(none_docs).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    lines = docs.where(h <= last).select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("p"))
    lines = lines.where((F.trim("p") != "") & ~F.lower("p").rlike("licen[cs]e|copyright|permission"))
    lines = lines.orderBy(F.xxhash64("p"), "p").limit(none_rows)
    return fit([r["p"].encode() for r in lines.collect()])  # at most none_rows paragraphs


_KIND = "array<struct<line:int,last_line:int,family:string,probability:double,confirmed:boolean>>"
_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("last_line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))


def scan_licenses(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", into: str = "licenses", none_docs: int = NONE_DOCS, none_rows: int = NONE_ROWS) -> DataFrame:
    """``docs`` with ``into``: the licence notices (first and last line, from 0), in order and without overlap.

    Every line and stretch of the whole text is classified. Null and empty texts
    have none. ``family`` is ``unknown`` where the classifier sees a notice that
    no template of the family it predicts confirms, or isn't sure of the family.
    Without prose to learn from (an empty table) the result is empty anyway.
    ``none_docs`` and ``none_rows`` bound what the class none is learned from.
    """
    model = train(docs, text=text, doc_id=doc_id, none_docs=none_docs, none_rows=none_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x families doubles: about 2 MB

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        found = [x for part in chunks(texts, RUN_BYTES) for x in scan_paragraphs(shared.value, text_bytes(part))]
        return {"found": pa.array(found, _ARROW)}

    return docs.withColumn(into, text_udf(run, {"found": _KIND})(F.col(f"`{text}`"))["found"])
