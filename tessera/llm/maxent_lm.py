"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of the next token is that of its class, given hashed n-gram and
skip features of the three tokens before, times that of its place in the class,
given features of the class and the tokens before. 32 classes of 32 places hold
the most frequent tokens and one symbol for all others, the tail. A word of the
tail has a code, the first bits of its hash, and the factors of its probability
are those of its code's bits, each a logistic regression on hashed features of
the bits before it and of the tokens before; the words of one code share its
probability by add-one counts. So every word of the corpus, however rare, is
predicted from its context, and is a context itself by its hash. Tables grow
with the training tokens, up to a size that can be broadcast.

Training is distributed: documents are dealt by a hash of their ids to shards
of some million tokens. In each round every shard takes gradient steps on its
own documents in order, starting from the round's model, and the shards' models
are averaged by their numbers of tokens; the result doesn't depend on how the
table is partitioned. Every training token is in one of the rounds. Counts of
the vocabulary are exact and may be of any size: only the most frequent words (a
fixed number) are broadcast to save looking them up, and all other tokens meet
their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, crc_mod, small_batches, text_bytes

#: Words whose counts are broadcast, a fixed bound; the others' counts are joined. It changes no result.
COMMON_WORDS = 1 << 17
CLASSES, MEMBERS = 32, 32
#: Bits of the codes of the tail.
BITS = 10
#: Rows of the tables, as powers of two: least, most, and the training tokens a row.
CLASS_ROWS, MEMBER_ROWS, TAIL_ROWS = (15, 16, 1 << 14), (14, 16, 1 << 15), (20, 22, 1 << 7)
#: Training tokens of a shard, and the most shards (more documents make them longer).
SHARD_TOKENS, SHARDS = 4_000_000, 4096
ROUNDS, BATCH, RATE = 2, 1 << 12, 0.12
#: Words counted in a task before it hands on its counts.
COUNTED = 400_000
HELD_OUT_OF, HELD_OUT = 7, 2
OTHER, END = 0, 1

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def word_key(word: bytes) -> int:
    """64 bits that stand for a word in the tables of counts (two words meet with a chance of 2**-64)."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def code_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Vocabulary:
    """``ids``: the most frequent words, from 2 on (0 stands for all others, 1 for the end); ``counts`` and ``keys`` by id; ``mass`` by code of the tail."""

    ids: dict[bytes, int]
    counts: np.ndarray
    tokens: int  # training tokens, ends included
    size: int  # distinct ones, the end included
    least: int = 1 << 62  # every word of this count or more has an id
    mass: np.ndarray | None = None  # counts of the words of a code that have no place of their own, add one each, and one for all unseen ones
    keys: np.ndarray | None = None

    def __post_init__(self):
        if self.mass is None:
            self.mass = np.ones(1 << BITS)
        self.keys = np.zeros(len(self.counts), np.uint64)
        self.keys[:2] = 1, 2
        for word, k in self.ids.items():
            self.keys[k] = xxhash.xxh3_64_intdigest(word)

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + self.size + 1))

    def symbols(self) -> np.ndarray:
        """Counts of the output symbols."""
        own = np.zeros(CLASSES * MEMBERS)
        n = min(len(self.counts), len(own))
        own[:n] = self.counts[:n]
        own[OTHER] = max(self.tokens - own[END:].sum(), 0)
        return own


def _rows(bounds: tuple[int, int, int], tokens: int) -> int:
    least, most, each = bounds
    return 1 << min(max(int(np.ceil(np.log2(max(tokens, 1) / each))), least), most)


class Model:
    """Weights: a table of class rows, one of member rows, one of single weights for the tail's bits, and the fixed intercepts of each."""

    def __init__(self, vocabulary: Vocabulary):
        mass = vocabulary.symbols().reshape(CLASSES, MEMBERS) + 0.5
        self.class_bias = np.log(mass.sum(axis=1)).astype(np.float32)
        self.member_bias = np.log(mass).astype(np.float32)
        self.class_rows = np.zeros((_rows(CLASS_ROWS, vocabulary.tokens), CLASSES), np.float32)
        self.member_rows = np.zeros((_rows(MEMBER_ROWS, vocabulary.tokens), MEMBERS), np.float32)
        self.tail = np.zeros(_rows(TAIL_ROWS, vocabulary.tokens), np.float32)
        # the bit after a prefix is one as often as the counts of the tail say: nodes are numbered like a heap, the root is 1
        heap = np.concatenate([np.zeros(1 << BITS), vocabulary.mass])
        for node in range((1 << BITS) - 1, 0, -1):
            heap[node] = heap[2 * node] + heap[2 * node + 1]
        self.node_bias = np.zeros(1 << BITS, np.float32)
        self.node_bias[1:] = np.log(heap[3::2]) - np.log(heap[2::2])

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared gradients so far, none."""
        return tuple(np.zeros(len(t), np.float32) for t in (self.class_rows, self.member_rows, self.tail))

    NAMES = ("class_rows", "member_rows", "tail")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size


def _slot(rows: int, salt: int, *ids: np.ndarray) -> np.ndarray:
    key = np.full(len(ids[0]), np.uint64(salt + 1))
    for k, x in enumerate(ids):
        key += x.astype(np.uint64, copy=False)
        key += np.uint64(1)
        key *= np.uint64(_ODD[k])
        key ^= key >> np.uint64(29)
    key >>= np.uint64(20)
    key &= np.uint64(rows - 1)  # tables have a power of two of rows
    return key.view(np.int64)


def contexts(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one, two and three tokens before, by their hashes; before a document's ``first`` token stand starts."""
    place = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    back = []
    for k in (1, 2, 3):
        b = np.empty(len(keys), np.uint64)
        b[k:] = keys[:-k]
        b[place < k] = 2 + k
        back.append(b)
    return tuple(back)


def features(model: Model, ids: np.ndarray, before: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Class and place of every token, the class rows of its n-gram and skip features, and its member rows."""
    w1, w2, w3 = before
    symbol = np.where(ids < CLASSES * MEMBERS, ids, OTHER)
    cls, member = symbol // MEMBERS, symbol % MEMBERS
    n, m = len(model.class_rows), len(model.member_rows)
    rows = [_slot(n, 0, w1), _slot(n, 1, w1, w2), _slot(n, 2, w2, w3)]
    return cls, member, rows, [_slot(m, 4, cls, w1), _slot(m, 5, cls, w2)]


_CODES = np.arange(1 << BITS)[:, None] | 1 << BITS
#: By code: its nodes, numbered like a heap from the root 1, its bits, and a hash of each node.
_NODES = _CODES >> np.arange(BITS, 0, -1)
_BITS_OF = ((_CODES >> np.arange(BITS - 1, -1, -1)) & 1).astype(bool)
_MARKS = _NODES.astype(np.uint64) * np.uint64(_ODD[3])


def bits_of(model: Model, keys: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of words of the tail, by row: their codes' bits, the intercept of each, and the places of the weights of its two features."""
    code = code_of(keys)
    node, bit = _NODES.take(code, axis=0), _BITS_OF.take(code, axis=0)
    mark, mask = _MARKS.take(code, axis=0), np.uint64(len(model.tail) - 1)
    places = []
    for k, w in enumerate((w1, w2)):
        key = (mark + (w * np.uint64(_ODD[k]) + np.uint64(k))[:, None]) * np.uint64(_ODD[4])
        places.append(((key >> np.uint64(32)) & mask).view(np.int64))
    return bit, model.node_bias.take(node), places


def _softmax(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    z += bias
    np.minimum(z, 80, out=z)  # the logits are small; a bound keeps the exponential finite
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def _chosen(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """log of the softmax at one column a row."""
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    z += bias
    np.minimum(z, 80, out=z)
    own = z[np.arange(len(which)), which]
    return own - np.log(np.einsum("ij->i", np.exp(z, out=z)))


def log_probability(model: Model, ids: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of every token, for one of the tail that of its code."""
    out = np.empty(len(ids), np.float32)
    before = contexts(keys, first)
    cls, member, rows, places = features(model, ids, before)
    tail = (ids == OTHER) | (ids >= CLASSES * MEMBERS)
    for a in range(0, len(ids), BATCH):
        s = slice(a, a + BATCH)
        out[s] = _chosen(model.class_rows, [r[s] for r in rows], model.class_bias, cls[s])
        out[s] += _chosen(model.member_rows, [r[s] for r in places], model.member_bias[cls[s]], member[s])
        t = a + np.flatnonzero(tail[s])
        if len(t):
            bit, z, at = bits_of(model, keys[t], before[0][t], before[1][t])
            z += model.tail.take(at[0])
            z += model.tail.take(at[1])
            np.clip(z, -20, 20, out=z)
            np.negative(z, out=z, where=bit)
            out[t] -= np.log((1 + np.exp(z, out=z)).prod(axis=1, dtype=np.float64))
    return out / np.float32(np.log(10))


def _descend(table: np.ndarray, power: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """A step on the rows, scaled by the root of each row's squared gradients so far. ``columns``: the gradients, transposed."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # tables have at most 2**16 rows: a radix sort
    ranked = rows.take(order)
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = ranked[new]
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = np.empty((len(columns), len(at)))
    for c, column in enumerate(columns):
        sums[c] = np.bincount(place, column, len(at))
    step = sums.T.astype(np.float32, order="C")
    power[at] += np.einsum("ij,ij->i", step, step)
    table[at] -= RATE * step / np.sqrt(power[at] + 1e-6)[:, None]


def learn(model: Model, state: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, keys: np.ndarray, first: np.ndarray) -> None:
    """Gradient steps over the tokens, a batch at a time, in place."""
    before = contexts(keys, first)
    cls, member, rows, places = features(model, ids, before)
    tail = (ids == OTHER) | (ids >= CLASSES * MEMBERS)
    for a in range(0, len(ids), BATCH):
        s = slice(a, a + BATCH)
        c, m = cls[s], member[s]
        n = np.arange(len(c))
        grad = _softmax(model.class_rows, [r[s] for r in rows], model.class_bias)
        grad[n, c] -= 1
        columns = np.ascontiguousarray(grad.T, np.float64)
        for r in rows:
            _descend(model.class_rows, state[0], r[s], columns)
        grad = _softmax(model.member_rows, [r[s] for r in places], model.member_bias[c])
        grad[n, m] -= 1
        columns = np.ascontiguousarray(grad.T, np.float64)
        for r in places:
            _descend(model.member_rows, state[1], r[s], columns)
        t = a + np.flatnonzero(tail[s])
        if len(t):
            bit, z, at = bits_of(model, keys[t], before[0][t], before[1][t])
            z += model.tail.take(at[0])
            z += model.tail.take(at[1])
            np.clip(z, -20, 20, out=z)
            np.exp(np.negative(z, out=z), out=z)
            grad = (1 / (1 + z) - bit).ravel()
            square = grad * grad
            for where in at:
                where = where.ravel()
                np.add.at(state[2], where, square)
                np.add.at(model.tail, where, np.float32(-RATE) * grad / np.sqrt(state[2].take(where) + np.float32(1e-6)))


def _ids(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and hashes of all tokens (each text's end included), marks of the first ones, and the numbers of tokens."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    words = list(chain.from_iterable(words))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    flat = np.empty(total, np.int32)
    body = np.ones(total, bool)
    body[ends - 1] = False
    ids = np.fromiter(map(vocabulary.ids.get, words, repeat(OTHER)), np.int32, len(words))
    flat[body] = ids
    flat[~body] = END
    keys = vocabulary.keys[flat]
    rare = np.flatnonzero(ids == OTHER)
    digest = xxhash.xxh3_64_intdigest
    keys[np.flatnonzero(body)[rare]] = np.fromiter((digest(words[j]) for j in rare.tolist()), np.uint64, len(rare))
    first = np.zeros(total, bool)
    first[ends - sizes] = True
    return flat, keys, first, sizes


def count_words(training: DataFrame, text: str = "text") -> DataFrame:
    """(key, word, c) of every distinct word of the training texts."""

    def count(batches):
        from collections import Counter

        seen: Counter = Counter()

        def hand_on():
            words = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([word_key(w) for w in words], pa.int64()), pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["key", "word", "c"]
            )

        for batch in batches:
            for part in chunks(batch.column(0)):
                for t in text_bytes(part):
                    seen.update(t.lower().split())
                    if len(seen) > COUNTED:
                        yield hand_on()
                        seen.clear()
        yield hand_on()

    parts = training.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "key bigint, word binary, c bigint")
    return parts.groupBy("key", "word").agg(F.sum("c").alias("c"))


def build_vocabulary(counted: DataFrame, documents: int) -> Vocabulary:
    """From the written-down counts: the totals, and the most frequent words (at most ``COMMON_WORDS`` rows reach the driver), and the masses of the tail's codes."""
    tokens, size = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # at most some hundred steps of counts, of which as many are taken from the top as have room
    steps = counted.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    room, least = COMMON_WORDS, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["least"]
    top = sorted(counted.where(F.col("c") >= least).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))
    counts = np.array([0, documents] + [r["c"] for r in top], np.int64)
    tail, own = counted, CLASSES * MEMBERS - 2
    if len(top) >= own:
        c, word = top[own - 1]["c"], bytes(top[own - 1]["word"])
        tail = counted.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(word))))
    elif top:
        tail = counted.where(F.col("c") < least)
    code = F.shiftrightunsigned("key", 64 - BITS)
    mass = np.ones(1 << BITS)
    for r in tail.groupBy(code.alias("code")).agg(F.sum(F.col("c") + 1).alias("m")).collect():  # at most 2 ** BITS rows
        mass[r["code"]] += r["m"]
    return Vocabulary({bytes(r["word"]): k + 2 for k, r in enumerate(top)}, counts, tokens + documents, size + (documents > 0), least, mass)


def _train_task(batches, shared=None, start=None):
    """One shard's model, in pieces."""
    model = Model(shared.value)
    state = model.state()
    if start is not None:
        model.load(start.value)
    n = 0
    for batch in batches:
        for part in chunks(batch.column(0)):
            ids, keys, first, _ = _ids(text_bytes(part), shared.value)
            learn(model, state, ids, keys, first)
            n += len(ids)
    if n:
        flat = model.flat().astype(np.float32)
        for k in range(0, len(flat), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[k : k + PIECE].tobytes()], pa.binary())], ["piece", "n", "w"])


#: Weights are averaged in pieces of this many, each by one task.
PIECE = 1 << 14


def _average(batches):
    """Weighted sums of the pieces that this partition holds."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for piece, n, w in zip(*(c.to_pylist() for c in batch.columns)):
            old, was = sums.get(piece, (0, 0))
            sums[piece] = (old + np.frombuffer(w, np.float32).astype(np.float64) * n, was + n)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(v / n).astype(np.float32).tobytes() for v, n in sums.values()], pa.binary())], ["piece", "w"])


def train(training: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text"):
    """The broadcast weights after ``ROUNDS`` rounds, one share of the documents each; None without documents."""
    sc = training.sparkSession.sparkContext
    shared, start = sc.broadcast(vocabulary), None
    share = F.pmod(F.xxhash64(F.lit("round"), F.col(doc_id)), F.lit(ROUNDS))
    shards = int(min(max(vocabulary.tokens / ROUNDS / SHARD_TOKENS, 1), SHARDS))
    order = F.xxhash64(F.lit("shard"), F.col(doc_id))
    for k in range(ROUNDS):
        part = training.where(share == k).select(F.col(f"`{text}`").alias("t"), order.alias("o"))
        part = part.repartitionById(shards, F.pmod("o", F.lit(shards)).cast("int")).sortWithinPartitions("o", "t").select("t")
        pieces = part.mapInArrow(partial(_train_task, shared=shared, start=start), "piece int, n bigint, w binary")
        # a piece's rows are as many as the tasks; the sums hold one piece's weights at a time
        got = pieces.repartition("piece").mapInArrow(_average, "piece int, w binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["piece"])])
            start = sc.broadcast(flat)
    return start


def _score_task(batches, shared=None, weights=None):
    vocabulary, model = shared.value, Model(shared.value)
    if weights is not None:
        model.load(weights.value)
    counts = vocabulary.counts
    log_count, log_mass = np.log10(counts + 1.0), np.log10(vocabulary.mass)
    for batch in batches:
        at = 0
        for part in chunks(batch.column(2)):
            ids, keys, first, sizes = _ids(text_bytes(part), vocabulary)
            starts = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, starts)
            said = log_probability(model, ids, keys, first).astype(np.float64)
            rare = ids == OTHER
            base = np.where(rare, 0.0, log_count[ids])
            tail = rare | (ids >= CLASSES * MEMBERS)
            said[tail] += base[tail] - log_mass[code_of(keys[tail])]
            known = ~rare & (counts[ids] > 0)
            bounds = np.concatenate([[0], np.cumsum(total(rare.astype(np.int64)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(sizes), pa.array(total(known.astype(np.int64))),
                    pa.array(total(base)), pa.array(total(said)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[rare].view(np.int64))),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "said", "rare"],
            )
            at += len(part)


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are their end alone. Repeated rows are scored each (and
    teach each). With nothing to train on (an empty table, or only held-out
    documents) counts are zero and the model is uniform over its symbols and codes.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, HELD_OUT_OF) == HELD_OUT).alias("held_out"), F.col(f"`{text}`").alias("text"))
    training = marked.where(~F.col("held_out"))
    counted = checkpoint(count_words(training))
    vocabulary = build_vocabulary(counted, training.count())
    weights = train(training, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, said double, rare array<bigint>"
    scored = marked.mapInArrow(partial(_score_task, shared=shared, weights=weights), schema)
    scored = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))  # written down, so the row numbers hold

    tail = counted.where(F.col("c") < vocabulary.least).select("key", "c")  # all words without an id
    tokens = scored.select("row", F.explode("rare").alias("key"))
    met = tokens.join(tail, "key").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_log"), F.count(F.lit(1)).alias("rare_known"))
    done = scored.drop("rare").join(met, "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * vocabulary.base_log).alias("base_score"),
        (F.col("said") + rare).alias("score"),
    )
