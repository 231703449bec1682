"""A quality classifier: a generalised additive model with pairwise interactions.

Texts become numeric features in numpy; each feature is cut into quantile
bins. Cyclic boosting visits the features in turn and fits a shallow tree (a
few cuts of the bins) to the gradient, adding it to the feature's lookup table;
then the pairs of features that lower the loss most get two-dimensional tables
in the same way. A score is the logistic of a sum of table entries, which numpy
looks up for a whole batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_bytes, text_udf, with_struct
from .quality_rules import SYMBOLS, duplicate_lines, repeated_words

#: The model is fitted on at most this many labelled rows, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
BINS, ROUNDS, LEAVES, RATE = 32, 120, 4, 0.15
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 40
CUTOFF = 0.3

FEATURES = (
    "log_words", "mean_word", "symbol_share", "digit_share", "upper_share", "letter_share", "punct_share", "repeat_share",
    "dup_line_share", "log_lines", "words_per_line", "distinct_share", "top_word_share", "bar_share", "bang_share", "stop_share",
)

_SETS = {
    "symbol": SYMBOLS, "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "punct": b".,;:!?", "bar": b"|", "bang": b"!",
}


def _only(keep: bytes) -> bytes:
    return bytes(set(range(256)) - set(keep))


_DROP = {k: _only(v) for k, v in _SETS.items()}
_SPACE = _only(b" \t\n\x0b\x0c\r")
#: The first bytes of capital letters with accents (Latin-1 supplement) can't be told apart by one byte; case is told by ASCII alone.
_HIGH = _only(bytes(range(0xC0, 0x100)))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` a text; an empty text has zeros."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.float64)
    flat = [x for w in words for x in w]
    hashes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n.astype(np.int64))
    count = {k: np.array([len(t.translate(None, d)) for t in texts], np.float64) for k, d in _DROP.items()}
    high = np.array([len(t.translate(None, _HIGH)) for t in texts], np.float64)
    solid = np.array([len(t) - len(t.translate(None, _SPACE)) for t in texts], np.float64)
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.float64)
    dup = np.array([duplicate_lines(t) for t in texts], np.float64)
    repeat = repeated_words(hashes, doc, len(texts)).astype(np.float64)
    distinct, top = np.zeros(len(texts)), np.zeros(len(texts))
    short = np.zeros(len(texts))
    for i, w in enumerate(words):
        if w:
            seen: dict[bytes, int] = {}
            for x in w:
                seen[x] = seen.get(x, 0) + 1
            distinct[i], top[i] = len(seen), max(seen.values())
            short[i] = sum(c for x, c in seen.items() if len(x) <= 3)
    some, chars = np.maximum(n, 1), np.maximum(solid, 1)
    return np.column_stack([
        np.log1p(n), solid / some, count["symbol"] / chars, count["digit"] / chars, count["upper"] / chars,
        (count["upper"] + count["lower"] + high) / chars, count["punct"] / chars, repeat / some, dup / lines, np.log(lines), n / lines,
        distinct / np.sqrt(some), top / some, count["bar"] / chars, count["bang"] / chars, short / some,
    ])


@dataclass
class Gam:
    cuts: list[np.ndarray]  # inner edges of each feature's bins
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # coarse bins of two features: (i, j, coarse, table)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]).astype(np.int64)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[bins[:, k]]
        for i, j, coarse, t in self.pairs:
            z += t[coarse[i][bins[:, i]], coarse[j][bins[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(self.bins(x))))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a shallow tree over ordered bins: greedy best cuts until ``leaves`` leaves, Newton values."""
    gain = lambda g, h: g * g / (h + 1.0)
    parts = [(0, len(grad))]
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(cg[m] - cg[a], ch[m] - ch[a]) + gain(cg[b] - cg[m], ch[b] - ch[m]) - gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], p, int(m[k]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _tree_of_pair(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a shallow tree over the grid of two features: greedy best cuts of rectangles, along either feature, until ``leaves`` leaves, Newton values."""
    gain = lambda g, h: g * g / (h + 1.0)
    out = np.zeros(grad.shape)
    parts = [(slice(0, grad.shape[0]), slice(0, grad.shape[1]))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            for axis in (0, 1):
                g, h = grad[a, b].sum(axis=1 - axis), hess[a, b].sum(axis=1 - axis)
                if len(g) > 1:
                    cg, ch = np.cumsum(g), np.cumsum(h)
                    won = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
                    k = int(np.argmax(won))
                    if won[k] > best[0]:
                        m = (a, b)[axis].start + k + 1
                        halves = ((slice(a.start, m), b), (slice(m, a.stop), b)) if axis == 0 else ((a, slice(b.start, m)), (a, slice(m, b.stop)))
                        best = (won[k], p, halves)
        if best[1] is None:
            break
        parts.pop(best[1])
        parts += best[2]
    for a, b in parts:
        out[a, b] = grad[a, b].sum() / (hess[a, b].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on all rows given. With no rows, or one class only, the score is constant: the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for k in range(width)]
    gam = Gam(cuts, [np.zeros(len(c) + 1) for c in cuts], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return gam
    bins = gam.bins(x)
    z = gam.logit(bins)
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-z))
            size = len(gam.tables[k])
            step = RATE * _tree(np.bincount(bins[:, k], y - p, size), np.bincount(bins[:, k], p * (1 - p), size), LEAVES)
            gam.tables[k] += step
            z += step[bins[:, k]]
    coarse = [(np.arange(len(t)) * PAIR_BINS // len(t)).astype(np.int64) for t in gam.tables]
    low = np.column_stack([c[bins[:, k]] for k, c in enumerate(coarse)])
    p = 1 / (1 + np.exp(-z))
    area = PAIR_BINS * PAIR_BINS
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            cell = low[:, i] * PAIR_BINS + low[:, j]
            g, h = np.bincount(cell, y - p, area), np.bincount(cell, p * (1 - p), area)
            gains.append((-float((g * g / (h + 1)).sum()), i, j))
    gam.pairs = [(i, j, coarse, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _c, table in gam.pairs:
            p = 1 / (1 + np.exp(-z))
            cell = low[:, i] * PAIR_BINS + low[:, j]
            step = RATE * _tree_of_pair(np.bincount(cell, y - p, area).reshape(table.shape), np.bincount(cell, p * (1 - p), area).reshape(table.shape), LEAVES)
            table += step
            z += step.ravel()[cell]
    return gam


def _features(texts: pa.Array) -> dict[str, pa.Array]:
    return {"x": pa.array(list(features(text_bytes(texts))), pa.list_(pa.float64()))}


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Gam:
    """Fits on labelled rows outside the held-out fifth, at most ``rows`` of them.

    Repeated labels of a document are averaged and rounded up from one half;
    null labels and null ids teach nothing. Only those rows' features reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (crc_mod(doc_id, 5) != 0))
    known = known.groupBy(F.col(doc_id).alias("k")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(rows)  # at most `rows` rows of 16 bytes, so the broadcast is bounded
    texts = docs.select(F.col(doc_id).alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")
    got = texts.groupBy("k").agg(F.min("t").alias("t"), F.min("y").alias("y"))  # repeated rows of a document teach once
    got = got.select("k", "y", text_udf(_features, {"x": "array<double>"})(F.col("t"))["x"].alias("x")).toPandas().sort_values("k")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from a score of 0.3 on).

    Every row gets a score, an empty or null text too (from zero features).
    Without usable labels all scores are 0.5.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, label=label, rows=rows)

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        return {"score": pa.array(model.score(features(text_bytes(texts))))}

    out = with_struct(docs, text_udf(score, {"score": "double"})(F.col(f"`{text}`")), ["score"])
    return out.withColumn("held_out", crc_mod(doc_id, 5) == 0).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
