"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point. A trigram's vector binds its three letters' vectors, the first permuted
twice and the second once, by multiplying them; a text's vector bundles (adds)
the vectors of all its trigrams, and a language's prototype bundles those of
its training texts. A text goes to the prototype of the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, text_strs, text_udf, with_struct

DIMENSIONS = 1024
#: Texts whose trigram counts are multiplied at once.
BLOCK = 256
#: Trigrams whose vectors exist at once; a script of thousands of letters has about as many trigrams as letters in its texts.
KEYS = 1 << 13
_LETTER = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x10000)), dtype=np.bool_)


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of code points; 0, which stands for a word's edge, has one too."""
    words = dimensions // 64
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(codes), words * 8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


class Trigrams:
    """The trigram counts of a block of texts: ``keys`` (three code points each), and by key the texts (``doc``) that hold it, and how often (``times``)."""

    def __init__(self, texts: list[str]):
        codes, doc = [], []
        for i, t in enumerate(texts):
            c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _LETTER[np.minimum(c, 0xFFFF)]
            far = np.flatnonzero(c >= 0x10000)
            if len(far):
                some, at = np.unique(c[far], return_inverse=True)
                letter[far] = np.array([chr(x).isalpha() for x in some])[at]
            c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint32)
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # one edge between words
            codes.append(c[keep])
            doc.append(np.full(int(keep.sum()), i, np.int64))
        c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        d = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.alphabet, index = np.unique(c, return_inverse=True)
        a = np.int64(max(len(self.alphabet), 1))
        if len(c) < 3:
            self.keys, self.key = np.zeros((0, 3), np.uint32), np.zeros(0, np.int64)
            self.doc, self.times, self.texts = self.key, self.key, len(texts)
            return
        index = index.astype(np.int64)
        key = (index[:-2] * a + index[1:-1]) * a + index[2:]
        ok = (d[:-2] == d[2:]) & (c[1:-1] != 0)  # an edge alone in the middle says nothing about a language
        key, d = key[ok], d[:-2][ok]
        if a**3 <= 1 << 21:
            seen = np.flatnonzero(np.bincount(key, minlength=int(a**3)))
            place = np.zeros(int(a**3), np.int64)
            place[seen] = np.arange(len(seen))
            at = place[key]
        else:
            seen, at = np.unique(key, return_inverse=True)
        self.keys = np.column_stack([self.alphabet[seen // (a * a)], self.alphabet[seen // a % a], self.alphabet[seen % a]])
        self.texts = len(texts)
        cell, self.times = np.unique(at * len(texts) + d, return_counts=True)
        self.key, self.doc = np.divmod(cell, max(len(texts), 1))

    def some(self) -> np.ndarray:
        """Which texts have a trigram."""
        return np.bincount(self.doc, minlength=self.texts) > 0

    def table(self) -> np.ndarray:
        """The counts as texts by trigrams."""
        out = np.zeros((self.texts, len(self.keys)), np.int64)
        out[self.doc, self.key] = self.times
        return out

    def bundles(self, group: np.ndarray, groups: int) -> np.ndarray:
        """The bundled vectors of ``groups`` of texts, whose numbers ``group`` gives: sums of bound vectors, ``KEYS`` trigrams at a time."""
        out = np.zeros((groups, DIMENSIONS), np.float32)
        for a in range(0, len(self.keys), KEYS):
            first, last = np.searchsorted(self.key, [a, a + KEYS])
            s = slice(first, last)
            vectors = bound(self.keys[a : a + KEYS])
            counts = np.bincount(group[self.doc[s]] * len(vectors) + self.key[s] - a, self.times[s], groups * len(vectors)).astype(np.float32)
            out += counts.reshape(groups, len(vectors)) @ vectors.astype(np.float32)
        return out


def bound(keys: np.ndarray) -> np.ndarray:
    """One vector a trigram."""
    letters, index = np.unique(keys, return_inverse=True)
    index = index.reshape(keys.shape)
    base = letter_vectors(letters)
    return np.roll(base, 2, axis=1)[index[:, 0]] * np.roll(base, 1, axis=1)[index[:, 1]] * base[index[:, 2]]


def _blocks(texts: list[str], most: int = 1 << 20):
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < BLOCK and (stop == start or size + len(texts[stop]) <= most):
            size += len(texts[stop])
            stop += 1
        yield start, texts[start:stop]
        start = stop


def prototypes(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The bundled vector of each non-null ``lang`` over all rows of ``docs``.

    Each task sends one vector a language; they are added by language. What
    reaches the driver is one vector of ``DIMENSIONS`` a language.
    """

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), text_strs(batch.column(1))
            for start, block in _blocks(texts):
                grams = Trigrams(block)
                names = sorted(set(langs[start : start + len(block)]))
                rows = np.array([names.index(x) for x in langs[start : start + len(block)]])
                for name, v in zip(names, grams.bundles(rows, len(names)).astype(np.float64)):
                    sums[name] = sums.get(name, 0) + v
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "v": pa.array([np.rint(v).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))}
        )

    small_batches(docs.sparkSession)
    parts = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"))
    sums = parts.mapInArrow(bundle, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    got: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        got[r["lang"]] = np.array([x["x"] for x in r["v"]], np.float64)
    return got


def predict(docs: DataFrame, known: dict[str, np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, from 0 to 1). Without a letter, or without a prototype: ``und`` and 0. Ties go to the first name."""
    names = sorted(n for n, v in known.items() if np.any(v))
    matrix = np.array([known[n] / np.linalg.norm(known[n]) for n in names], np.float32).T if names else None

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        langs, scores = [], []
        for _, block in _blocks(text_strs(texts)):
            grams = Trigrams(block)
            some = grams.some()
            if matrix is None or not some.any():
                langs += ["und"] * len(block)
                scores += [0.0] * len(block)
                continue
            v = grams.bundles(np.arange(len(block)), len(block))
            cosine = (v @ matrix) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(axis=1)
            langs += [names[b] if s else "und" for b, s in zip(best, some)]
            scores += [float(min(max(c[b], 0.0), 1.0)) if s else 0.0 for c, b, s in zip(cosine, best, some)]
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    return with_struct(docs, text_udf(run, {"lang_pred": "string", "score": "double"})(F.col(f"`{text}`")), ["lang_pred", "score"])


def identify_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learns from all rows outside the held-out fifth that have a language.

    A text without a letter (null and empty ones too) is ``und``; so is every
    text if nothing could be learned. The language column is read for training only.
    """
    known = prototypes(docs.where(crc_mod(doc_id, 5) != 0), text=text, lang=lang)
    return predict(docs, known, text=text).withColumn("held_out", crc_mod(doc_id, 5) == 0)
