"""Benchmark decontamination by the CGK embedding.

Texts are sequences of normalised words. The embedding walks over a sequence:
at step j it writes down the word under the pointer and moves on if a random
bit of (j, word) says so. Two sequences within a small edit distance fall back
into step after each edit, so their embeddings have a small Hamming distance.

Windows of about an item's size are taken from every document at a stride; the
items are embedded from as many shifted starts, so that one of a passage's
windows is always aligned with one start of its item. A long item is embedded
from the starts of all its parts of a fixed size, any of which finds it: samples
of a walk over hundreds of words would hardly ever miss all edits. Keys of a few sampled
positions of the embedding, from several walks, are looked up in the items'
keys (bit-sampling LSH), and what meets is verified by the exact edit distance
of the item to the best stretch of the document's words around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, text_bytes, text_udf, written

#: An item is found if a stretch of the text is within this share of the item's words in edits.
MAX_EDITS = 0.2
WALKS, KEYS_PER_WALK, SAMPLED = 2, 8, 5
STRIDE = 8
#: Items of at most ``FEW`` words, whose walks one edit throws out of step nearly at once, are embedded from all their words, and keys have fewer positions.
FEW, SAMPLED_OF_FEW = 6, 2
#: Items of more words than ``WHOLE`` are looked up by parts of ``PART`` words.
WHOLE, PART = 32, 26
#: Items are handled in blocks of at most this many parts, or of one item, one pass over the documents each: a block's index is bounded, about 20 kB a part.
ITEM_BLOCK = 5_000

_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(128)).lower() + bytes(range(128, 256))
_BLOOM = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII punctuation."""
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Shape:
    """Items of about one size: windows of ``size`` words are taken every ``stride`` words."""

    size: int
    stride: int


def shape_of(n: int) -> Shape:
    stride = 1
    while stride < STRIDE and n >= 5 * stride:
        stride *= 2
    size = 1
    while max(size + 1, size * 3 // 2) <= n - stride + 1:
        size = max(size + 1, size * 3 // 2)
    return Shape(size, stride)


def parts_of(n: int) -> list[int]:
    """Where the parts of an item of ``n`` words begin: they cover it, the last one overlaps if need be."""
    return [0] if n <= WHOLE else [*range(0, n - PART, PART), n - PART]


class Index:
    """The keys of a block of items. ``items``: (item id, text)."""

    def __init__(self, items: list[tuple[object, bytes]], max_edits: float = MAX_EDITS, seed: int = 11):
        known = [(i, words_of(t)) for i, t in items]
        known = [(i, w) for i, w in known if w]
        self.max_edits, self.vocabulary = max_edits, {}
        self.ids, self.items = [], []
        for item, words in known:
            self.ids.append(item)
            self.items.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.sets = [frozenset(x) for x in self.items]
        rng = np.random.default_rng(seed)
        self.shapes: dict[Shape, list] = {}
        by: dict[Shape, list[int]] = {}
        for k, it in enumerate(self.items):
            by.setdefault(shape_of(len(it) if len(it) <= WHOLE else PART), []).append(k)
        for shape, members in sorted(by.items(), key=lambda x: (x[0].size, x[0].stride)):
            few = shape.size <= FEW
            steps = shape.size if few else 2 * shape.size - 2
            most = min(SAMPLED_OF_FEW, steps) if few else SAMPLED
            offsets = [list(range(max(len(self.items[k]) - 1, 1))) if few else [p + s for p in parts_of(len(self.items[k])) for s in range(shape.stride)] for k in members]
            owner = np.repeat(members, [len(x) for x in offsets])
            shift = np.concatenate([np.array(x, np.int64) for x in offsets])
            flat = np.zeros(sum(len(self.items[k]) for k in members) + len(members) * (steps + shape.stride), np.int32)
            starts, at = [], 0
            for k, own in zip(members, offsets):
                flat[at : at + len(self.items[k])] = self.items[k]
                starts += [at + s for s in own]
                at += len(self.items[k]) + steps + shape.stride
            walks = []
            for _ in range(WALKS):
                moves = rng.integers(0, 2, (steps, len(self.vocabulary) + 1), dtype=np.uint8)
                tables = []
                for r in range(KEYS_PER_WALK):
                    # samples of one key come from a stretch of the walk: a half, or a third, of it
                    width = max(min(most, steps), steps // (2 + r % 2))
                    low = int(rng.integers(0, steps - width + 1)) if r else 0
                    places = np.sort(rng.choice(width, min(most, width), replace=False)) + low
                    tables.append((places, rng.integers(1, 1 << 62, len(places), dtype=np.uint64) | np.uint64(1)))
                keys = self._keys(flat, np.array(starts, np.int64), moves, tables)
                made = []
                for (places, mult), key in zip(tables, keys):
                    order = np.argsort(key, kind="stable")
                    bloom = np.zeros(_BLOOM, bool)
                    bloom[(key >> np.uint64(48)).astype(np.int64)] = True
                    made.append((places, mult, key[order], owner[order], shift[order], bloom))
                walks.append((moves, made))
            self.shapes[shape] = walks

    @staticmethod
    def _keys(flat: np.ndarray, starts: np.ndarray, moves: np.ndarray, tables: list) -> list[np.ndarray]:
        wanted = {int(p) for t in tables for p in t[0]}
        at, said = starts.copy(), {}
        for j in range(max(wanted) + 1):
            word = flat.take(at, mode="clip")
            if j in wanted:
                said[j] = word.astype(np.uint64) + np.uint64(1)
            at += moves[j].take(word, mode="clip")
        out = []
        for t in tables:
            key = np.zeros(len(starts), np.uint64)
            for p, m in zip(t[0], t[1]):
                key = (key ^ (said[int(p)] * m)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out.append(key * np.uint64(0xBF58476D1CE4E5B9))
        return out

    def candidates(self, flat: np.ndarray, n: int) -> np.ndarray:
        """Rows (start of the item in ``flat``, item index) to verify, each once; ``flat`` has room after its ``n`` words."""
        found = []
        for shape, walks in self.shapes.items():
            starts = np.arange(0, n, shape.stride, dtype=np.int64)
            for moves, tables in walks:
                for (_, _, sorted_keys, owner, shift, bloom), key in zip(tables, self._keys(flat, starts, moves, [t[:2] for t in tables])):
                    some = np.flatnonzero(bloom[(key >> np.uint64(48)).astype(np.int64)])
                    low = np.searchsorted(sorted_keys, key[some], side="left")
                    high = np.searchsorted(sorted_keys, key[some], side="right")
                    times = high - low
                    if times.any():
                        which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        found.append(np.column_stack([np.repeat(starts[some], times) - shift[which], owner[which]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    @property
    def room(self) -> int:
        return max([0, *(2 * s.size + s.stride for s in self.shapes)]) + 1


def best_stretch(item: list[int], words: list[int], most: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``words`` closest to ``item``, the first of such; None beyond ``most`` edits.

    Bit-parallel: one step a word, each a few operations on integers of the item's length.
    """
    peq: dict[int, int] = {}
    for k, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best = full, 0, len(item), (len(item), 0)
    for at, w in enumerate(words):
        eq = peq.get(w, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = plus & d0
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        if score < best[0]:
            best = (score, at + 1)
        hp, hn = hp << 1 & full, hn << 1 & full  # the stretch may begin anywhere
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0
    return best if best[0] <= most else None


def find_items(index: Index, texts: list[bytes]) -> list[list[dict]]:
    """For each text its items: item (index), edits, and the word span of the closest stretch found."""
    split = [words_of(t) for t in texts]
    get = index.vocabulary.get
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    flat = np.zeros(n + index.room, np.int32)
    flat[:n] = np.fromiter((get(w, 0) for ws in split for w in ws), np.int32, n)
    out: list[list[dict]] = [[] for _ in texts]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    known = flat.tolist()
    for start, k in index.candidates(flat, n).tolist() if n and index.items else []:
        item = index.items[k]
        most = int(index.max_edits * len(item))
        doc = int(np.searchsorted(ends, min(max(start, 0) + len(item) // 2, n - 1), side="right"))
        first = int(ends[doc] - sizes[doc])
        for doc, first in ((doc, first), (doc - 1, int(ends[doc - 1] - sizes[doc - 1]))) if doc and start < first else ((doc, first),):
            low, high = max(first, start - most), min(int(ends[doc]), start + len(item) + most)
            if high - low < len(item) - most:
                continue
            words = known[low:high]
            if len(index.sets[k].intersection(words)) < len(index.sets[k]) - most:
                continue
            got = best_stretch(item, words, most)
            if got and (old := best.get((doc, k)), new := (got[0], low - first, low - first + got[1])) and (old is None or new < old):
                best[doc, k] = new
    for (doc, k), (edits, low, high) in sorted(best.items()):
        out[doc].append({"item": k, "edits": edits, "start": low, "end": high})
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").toLocalIterator():
        item = r["t"].encode()
        parts = len(parts_of(len(words_of(item))))
        if block and size + parts > ITEM_BLOCK:
            yield block
            block, size = [], 0
        block.append((r["i"], item))
        size += parts
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, into: str = "leaks") -> DataFrame:
    """``docs`` with ``into``: array<struct<item_id, edits, start, end>>, the benchmark items that the text holds.

    start and end are the words around the stretch that was closest (the stretch
    ends at ``end``). Whole texts are searched. Null or wordless texts and items
    hold and are nothing; items of equal text are all reported, and so are
    repeated rows. Without items, and for an empty table, the arrays are empty.
    """
    id_type = benchmark.schema[item_id].dataType
    kind = f"array<struct<item_id:{id_type.simpleString()},edits:int,start:bigint,end:bigint>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def found_in(column, block):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, max_edits))

        def run(texts: pa.Array) -> dict[str, pa.Array]:
            index = shared.value
            rows = find_items(index, text_bytes(texts))
            said = [[{"item_id": index.ids[x["item"]], "edits": x["edits"], "start": x["start"], "end": x["end"]} for x in r] for r in rows]
            return {"found": pa.array(said, arrow)}

        return text_udf(run, {"found": kind})(column)["found"]

    blocks = _blocks(benchmark, item_id, item_text)
    block, after = next(blocks, None), next(blocks, None)
    if after is None:
        return docs.withColumn(into, F.array().cast(kind) if block is None else found_in(F.col(f"`{text}`"), block))
    # several blocks: one index at a time is built, broadcast and held by the workers; what a block finds is written down
    row, key, some = free_name(docs, "leak_row"), free_name(docs, "leak_key"), free_name(docs, "leak_found")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows")
    hits = None
    for block in chain((block, after), blocks):
        got = numbered.select(F.col(row).alias(key), found_in(F.col(f"`{text}`"), block).alias("found")).where(F.size("found") > 0)
        got = written(got, "leaks")
        hits = got if hits is None else hits.unionByName(got)
    hits = hits.groupBy(key).agg(F.flatten(F.collect_list("found")).alias("found"))  # at most a row a block and document
    joined = numbered.drop(into).join(hits.withColumnRenamed("found", some), F.col(row) == F.col(key), "left")
    return joined.withColumn(into, F.coalesce(F.col(some), F.array().cast(kind))).drop(row, key, some)
