"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, by numpy exclusive-or and bit counts, in
tiles of bounded size. Which rows meet in a tile is settled by blocks: two
64-bit fingerprints that differ in at most three bits agree in one of four
16-bit bands, so comparing within the bands finds every such pair. Within a
block rows are ordered by population count; since the difference of two
population counts is a lower bound of the distance, pairs and whole pairs of
tiles whose counts differ beyond the radius are skipped.

A block of more than ``TILE_ROWS`` rows is cut into tiles by population count
and hash, and each pair of tiles within the radius is a task's work of its own,
so no block, however large, has to fit into one task. A tile emits the links of
a spanning forest of what it finds instead of all pairs: links between
components that are already joined add nothing to a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, text_bytes, text_udf, written
from .components import bounded, connected_components

RADIUS, SHINGLE, SEED, BANDS = 3, 3, 42, 4
#: Rows of one tile. Two tiles of 40 bytes a row meet in a task.
TILE_ROWS = 16_384
#: Cells of at most this many rows are compared together, larger ones square by square.
SMALL, SQUARE = 48, 512

#: For the stage on similar texts: shingles of five words, 256 bits, and the blocks of each text.
WIDE_SHINGLE, WIDE_WORDS, WIDE_BLOCKS = 5, 4, 16
#: What tells the cells of a comparison apart.
CELL = ("block", "t1", "t2")
_CELL_SCHEMA = "block bigint, t1 int, t2 int"
#: Rows of one tile of that stage: in doubt they carry sketches of at most 4 kB.
STAGE_ROWS = 4096
#: Pairs of a square of which at most this many are in doubt are decided one by one, more by a product of matrices of this many hashes' columns.
FEW_PAIRS, COLUMNS = 32, 4096
#: Shingle hashes of a text that are written down for decisions, the smallest ones; a text of fewer has its whole set.
SKETCH = 1024
#: Pairs of larger sets are decided by their sketches where these are this many standard deviations from the similarity, else by the whole sets.
SKETCH_SD = 6.0
_MIXES = (None, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``shingle`` words of the lower-cased text, of the whole sequence if it has fewer words, of nothing if it has none."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)] if words else []
    return [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)))]


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    if not word:
        return h
    m = np.uint64(_MIXES[word])
    x = (h ^ (h >> np.uint64(31))) * m
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def majority_bits(hashes: np.ndarray, ends: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprints of documents whose hashes stand one after another, the last of each before ``ends``: documents by ``words``, uint64.

    A bit is 1 if it is set in over half of a document's hashes; no hashes give zero.
    """
    out = np.zeros((len(ends), words), np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for word in range(words):
        sums = np.zeros((len(ends), 64), np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = _mixed(hashes[at : at + (1 << 16)], word)
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
            first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
            docs = np.arange(first, last + 1)
            docs = docs[ends[docs] > starts[docs]]
            begin = np.maximum(starts[docs] - at, 0)
            sums[docs] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        on = 2 * sums > (ends - starts)[:, None]
        out[:, word] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(texts: pa.Array) -> dict[str, pa.Array]:
    hashes = [shingle_hashes(t) for t in text_bytes(texts)]
    ends = np.cumsum([len(h) for h in hashes], dtype=np.int64)
    flat = np.array([x for h in hashes for x in h], np.uint64)
    return {"fp": pa.array(majority_bits(flat, ends)[:, 0].view(np.int64))}


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text as a signed long; null and empty texts have zero."""
    return text_udf(_fingerprints, {"fp": "bigint"})(text)["fp"]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indexes by the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[i] != label[j]
        if not open_.any():
            break
    return label


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; a and b broadcast but for their last axis, the words."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for w in range(1, a.shape[-1]):
        d += np.bitwise_count(a[..., w] ^ b[..., w])
    return d


def _sizes_allow(size: np.ndarray | None, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of these sizes can have the similarity: the smaller one must have this share of the larger."""
    if size is None:
        return np.ones(len(i), bool)
    a, b = size[i], size[j]
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def compare_cells(
    cell: np.ndarray, side: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int, doubt: int = 0, size: np.ndarray | None = None, similarity: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows, and whether each row is in a doubtful pair.

    Labels are equal for rows of one cell that links within ``radius`` join:
    the smallest index of those. Doubtful pairs differ in more bits, ``doubt``
    at most (none by default), have different labels, and their sets' sizes
    (``size``) allow the similarity.

    Rows come ordered by cell and population count. ``side`` is -1 in a cell
    that is compared within itself; otherwise only rows of side 0 and side 1 are compared.
    """
    n, reach = len(cell), max(radius, doubt)
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([edge, [n]]))
    rank = np.repeat(sizes, sizes)
    found = []
    i = np.flatnonzero((rank <= SMALL) & (rank > 1))
    d = 0
    while len(i):
        d += 1
        i = i[i + d < n]
        j = i + d
        i = i[(cell[j] == cell[i]) & (pop[j] - pop[i] <= reach)]
        j = i + d
        far = _distance(fp[i], fp[j])
        hit = (far <= reach) & ((side[i] < 0) | (side[i] != side[j]))
        found.append((i[hit], j[hit], far[hit]))
    i, j, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    label = _labels(n, i[far <= radius], j[far <= radius])
    marked = np.zeros(n, bool)
    unsure = (far > radius) & (label[i] != label[j]) & _sizes_allow(size, i, j, similarity)
    marked[i[unsure]] = marked[j[unsure]] = True
    for start, many in zip(edge[sizes > SMALL], sizes[sizes > SMALL]):
        rows = slice(start, start + many)
        for i, j, _ in _squares(rows, side, pop, fp, radius):
            _join(label, np.arange(rows.start, rows.stop), label[i], label[j])
        if doubt > radius:
            for i, j, _ in _squares(rows, side, pop, fp, doubt):
                apart = (label[i] != label[j]) & _sizes_allow(size, i, j, similarity)
                marked[i[apart]] = marked[j[apart]] = True
    return label, marked


def _squares(rows: slice, side: np.ndarray, pop: np.ndarray, fp: np.ndarray, reach: int):
    """Pairs of rows within ``reach`` and their distances, a square of the cell's rows at a time."""
    own = np.arange(rows.start, rows.stop)
    two = side[rows.start] >= 0
    left = own[side[own] <= 0]
    right = own[side[own] == 1] if two else left
    for a in range(0, len(left), SQUARE):
        x = left[a : a + SQUARE]
        for b in range(0 if two else a, len(right), SQUARE):
            y = right[b : b + SQUARE]
            if pop[y[0]] - pop[x[-1]] > reach:
                break  # rows are ordered by population count: all further squares are beyond the radius
            if pop[x[0]] - pop[y[-1]] > reach:
                continue
            far = _distance(fp[x][:, None, :], fp[y][None, :, :])
            i, j = np.nonzero(far <= reach)
            yield x[i], y[j], far[i, j]


def _join(label: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the labels i and j, pair by pair, in the rows ``own``."""
    apart = i != j
    if apart.any():
        names, at = np.unique(np.concatenate([i[apart], j[apart]]), return_inverse=True)
        half = len(at) // 2
        joined = names[_labels(len(names), at[:half], at[half:])]
        place = np.minimum(np.searchsorted(names, label[own]), len(names) - 1)
        label[own] = np.where(names[place] == label[own], joined[place], label[own])


def _by_cell(emit):
    """mapInArrow over rows ordered by cell and population count; ``emit`` gets whole cells: a table and the number of each row's cell."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            keys = [table.column(k).to_numpy() for k in CELL]
            new = np.zeros(len(table), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            rest = table.slice(last)
            if last:
                yield from emit(table.slice(0, last), np.cumsum(new)[:last])
        if rest is not None and len(rest):
            yield from emit(rest, np.zeros(len(rest), np.int64))

    return run


def _table_prints(table: pa.Table, words: int) -> np.ndarray:
    return np.column_stack([table.column(f"f{w}").to_numpy().view(np.uint64) for w in range(words)])


def _tiles(radius: int, words: int, doubt: int, similarity: float):
    """The links (u, v) of every cell, and its rows in doubt as (u, null) with their side and cell."""

    def emit(table, cell):
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        size = table.column("size").to_numpy() if "size" in table.column_names else None
        label, marked = compare_cells(cell, side, table.column("pop").to_numpy(), _table_prints(table, words), radius, doubt, size, similarity)
        moved, marked = np.flatnonzero(node != node[label]), np.flatnonzero(marked)
        u = np.concatenate([moved, marked])
        if len(u):
            link = np.arange(len(u)) < len(moved)
            other = pa.array(np.concatenate([node[label[moved]], np.zeros(len(marked), np.int64)]), mask=~link)
            where = [pa.array(table.column(k).to_numpy()[u], mask=link) for k in ("side", *CELL)]
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), other, *where], ["u", "v", "side", *CELL])

    return _by_cell(emit)


def similar_in_square(sketches: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of rows 1 if their sets have the similarity, 0 if not, 2 if their sketches leave it open, as ``by_sketch`` says.

    Sets that are their own sketches are compared all at once: common hashes are
    counted by a product of matrices, rows by hashes that at least two rows have.
    """
    out = np.zeros(len(i), np.int8)
    whole = (size[i] <= SKETCH) & (size[j] <= SKETCH)
    single = ~whole if whole.sum() > FEW_PAIRS else np.ones(len(i), bool)
    for k in np.flatnonzero(single).tolist():
        a, b = int(i[k]), int(j[k])
        out[k] = by_sketch(sketches[a], int(size[a]), sketches[b], int(size[b]), similarity)
    at = np.flatnonzero(~single)
    if len(at):
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        x, y = place[: len(at)], place[len(at) :]
        have = [sketches[r] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in have])
        _, hashes, times = np.unique(np.concatenate(have), return_inverse=True, return_counts=True)
        shared = times > 1
        column = (np.cumsum(shared) - 1)[hashes]
        keep = shared[hashes]
        order = np.argsort(column[keep], kind="stable")
        column, owner = column[keep][order], owner[keep][order]
        common = np.zeros((len(rows), len(rows)), np.float32)
        for c in range(0, int(shared.sum()), COLUMNS):
            first, last = np.searchsorted(column, [c, c + COLUMNS])
            m = np.zeros((len(rows), COLUMNS), np.float32)
            m[owner[first:last], column[first:last] - c] = 1
            common += m @ m.T
        n = common[x, y].astype(np.float64)
        out[at] = n >= similarity * (size[i[at]].astype(np.int64) + size[j[at]] - n)
    return out


def decide_cell(side: np.ndarray, pop: np.ndarray, fp: np.ndarray, size: np.ndarray, label: np.ndarray, sketches: list[np.ndarray], radius: int, doubt: int, similarity: float):
    """Of one cell the pairs of rows that join what ``label`` leaves apart, a spanning forest of those; and the pairs that sketches leave open.

    Every doubtful pair of rows that are still apart is decided, a square at a
    time; none is handed on but those that hold. Rows in more bits than
    ``doubt`` can't be similar, those within ``radius`` are joined already.
    """
    names, at = np.unique(label, return_inverse=True)
    above = np.arange(len(names))
    joined, unclear = [], []
    for i, j, far in _squares(slice(0, len(side)), side, pop, fp, doubt):
        new = (far > radius) & _sizes_allow(size, i, j, similarity)
        if side[0] < 0:
            new &= i < j  # a square of the diagonal has each pair twice
        i, j = i[new], j[new]
        while not np.array_equal(above, above[above]):
            above = above[above]
        apart = above[at[i]] != above[at[j]]
        i, j = i[apart], j[apart]
        got = similar_in_square(sketches, size, i, j, similarity)
        for k in np.flatnonzero(got == 1).tolist():
            a, b = int(at[i[k]]), int(at[j[k]])
            while above[a] != a:
                a = int(above[a])
            while above[b] != b:
                b = int(above[b])
            if a != b:
                above[max(a, b)] = min(a, b)
                joined.append((i[k], j[k]))
        unclear += zip(i[got == 2].tolist(), j[got == 2].tolist())
    return joined, unclear


def _decided(radius: int, words: int, doubt: int, similarity: float):
    """The links (u, v, true) that hold among the doubtful pairs of every cell, and (u, v, false) those that the whole sets have to decide."""

    def emit(table, cell):
        fp = _table_prints(table, words)
        node, side, pop, size, label = (table.column(k).to_numpy() for k in ("node", "side", "pop", "size", "label"))
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            s = slice(a, b)
            if b - a < 2 or (label[s] == label[a]).all():
                continue
            sketches = [np.frombuffer(x, np.uint32) for x in table.column("sketch").slice(a, b - a).to_pylist()]
            joined, unclear = decide_cell(side[s], pop[s], fp[s], size[s], label[s], sketches, radius, doubt, similarity)
            if joined or unclear:
                i, j = (node[a + np.array(x, np.int64)] for x in zip(*joined, *unclear))
                sure = np.arange(len(i)) < len(joined)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sure)], ["u", "v", "sure"])

    return _by_cell(emit)


def near_links(points: DataFrame, *, words: int, radius: int, doubt: int = 0, similarity: float = 0.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that join all rows of one block whose fingerprints differ in at most ``radius`` bits.

    Rows that differ from another one of their block and of their size in more
    bits, up to ``doubt``, and aren't joined with it, come as (u, null) with
    their side and cell (block, t1, t2).

    ``points``: block long, node long, f0.. long, one row for each block of a
    node, and with ``doubt`` the size of its set. It is read twice, so it should
    be cheap or written down.
    """
    rows = _dealt(_cells(points, words=words, reach=max(radius, doubt), tile_rows=tile_rows, also=("size",) if "size" in points.columns else ()))
    return rows.mapInArrow(_tiles(radius, words, doubt, similarity), f"u bigint, v bigint, side int, {_CELL_SCHEMA}")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "pop", "node")


def _cells(points: DataFrame, *, words: int, reach: int, tile_rows: int, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of every cell (block, t1, t2), with the columns ``also`` of ``points``; a block's cells depend on its own points alone."""
    pop = sum((F.bit_count(f"f{w}") for w in range(1, words)), F.bit_count("f0")).cast("int")
    points = points.withColumn("pop", pop)
    layout = points.groupBy("block", "pop").agg(F.count(F.lit(1)).alias("n"))
    # the tiles of each block with more rows than a tile; at most (rows / tile_rows) blocks
    layout = layout.groupBy("block").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile_rows).cast("int").alias("k")))).alias("levels"))
    hot = checkpoint(layout.where(F.col("rows") > tile_rows).select("block", "levels"))
    n_hot = hot.count()
    fields = ["block", "node", *(f"f{w}" for w in range(words)), "pop", *also]
    cold = points
    cells = []
    if n_hot:
        cold = points.join(bounded(hot.select("block"), n_hot, 20_000), "block", "left_anti")
        rows = points.join(bounded(hot, n_hot, 2_000), "block")
        mine = lambda x: x["pop"] == F.col("pop")
        sub = F.pmod(F.xxhash64("node"), F.element_at(F.filter("levels", mine), 1)["k"].cast("bigint")).cast("int")
        rows = rows.withColumn("own", F.col("pop") * 65536 + sub)
        near = F.filter("levels", lambda x: F.abs(x["pop"] - F.col("pop")) <= reach)
        others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["k"] - 1), lambda h: x["pop"] * 65536 + h)))
        rows = rows.withColumn("other", F.explode(others))
        cells.append(rows.select(
            *fields, F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
            F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        ))
    cells.append(cold.select(*fields, F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(-1).alias("side")))
    return cells[0] if len(cells) == 1 else cells[0].unionByName(cells[1])


def band_points(prints: DataFrame) -> DataFrame:
    """Rows of ``near_links`` for distinct 64-bit fingerprints ``fp``, each its own node, in four 16-bit bands."""
    width = 64 // BANDS
    bands = [F.lit(k << width) + F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND((1 << width) - 1) for k in range(BANDS)]
    return prints.select(F.explode(F.array(*bands)).alias("block"), F.col("fp").alias("node"), F.col("fp").alias("f0"))


def link_fingerprints(points: DataFrame, *, doc_id: str = "doc_id", fp: str = "fp", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``points``, which should be written down: it is read twice.

    Equal fingerprints are one node. component_id is the smallest id reachable
    by links of at most three differing bits; it is null only if all ids in reach are.
    """
    prints = checkpoint(points.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    links = near_links(band_points(prints), words=1, radius=RADIUS, tile_rows=tile_rows)
    roots = connected_components(links.select("u", "v"))
    linked = checkpoint(prints.join(roots, prints["fp"] == roots["node"]).select("fp", "least", "root"))
    heads = checkpoint(linked.groupBy("root").agg(F.min("least").alias("head")))
    moved = checkpoint(linked.join(bounded(heads, heads.count()), "root").select(F.col("fp").alias("moved_fp"), "head"))
    # two plain steps on purpose: the first touches distinct fingerprints, the second is an equi-join that AQE may split at a hot fingerprint
    heads = checkpoint(prints.join(bounded(moved, moved.count()), F.col("fp") == F.col("moved_fp"), "left").select(F.col("fp").alias("key"), F.coalesce("head", "least").alias("component_id")))
    return points.join(heads, points[fp] == heads["key"]).select(F.col(doc_id), F.col(fp), "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, fp, component_id.

    Texts without words have fingerprint zero and link like any other. Repeated
    rows share a component. An empty table gives an empty result.
    """
    points = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fp")))
    return link_fingerprints(points)


# --- texts of a similarity of 0.8 or more ---------------------------------------------------


def wide_distance(similarity: float, words: int = WIDE_WORDS) -> tuple[float, float]:
    """Mean and standard deviation of the distance of the fingerprints of two sets with this Jaccard similarity.

    Their cosine is 2 J / (1 + J), and a bit differs with a chance of its angle over pi.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return 64 * words * p, (64 * words * p * (1 - p)) ** 0.5


def _sequence_hash(text: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(text.lower().split()))


def _wide(texts: pa.Array) -> dict[str, pa.Array]:
    raw = text_bytes(texts)
    sets = [_set(t) for t in raw]
    ends = np.cumsum([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    prints = majority_bits(flat, ends, WIDE_WORDS).view(np.int64)
    return {
        "seq": pa.array([_sequence_hash(t) for t in raw], pa.string()),
        "size": pa.array([len(s) for s in sets], pa.int32()),
        "f": pa.array(list(prints), pa.list_(pa.int64())),
        "blocks": pa.array([s[:WIDE_BLOCKS].view(np.int64) for s in sets], pa.list_(pa.int64())),
        "sketch": pa.array([_sketch(s).tobytes() for s in sets], pa.binary()),
    }


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the smallest hashes of an ordered set; two different ones of a pair of sets meet with a chance of 2**-32."""
    return np.unique((hashes[:SKETCH] >> np.uint64(32)).astype(np.uint32))


def _set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, WIDE_SHINGLE), np.uint64))


def _node(seq: Column) -> Column:
    """60 bits of a sequence's hash; different sequences meet with a chance of 2**-60 a pair."""
    return F.conv(F.substring(seq, 1, 15), 16, 10).cast("bigint")


def by_sketch(x: np.ndarray, size_a: int, y: np.ndarray, size_b: int, similarity: float) -> int:
    """1 if two sets have the similarity, 0 if not, 2 if their sketches leave it open.

    Sets within ``SKETCH`` are their own sketches and decide exactly. Of larger
    ones the ``SKETCH`` smallest hashes of the union are an even sample of it.
    """
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    if size_a <= SKETCH and size_b <= SKETCH:
        common = int(twice.sum())
        return int(common >= similarity * (size_a + size_b - common))
    first = np.concatenate([[True], ~twice])
    at = np.flatnonzero(first)
    last = at[SKETCH] if len(at) > SKETCH else len(both)  # where the sample ends
    n = min(SKETCH, len(at))
    share = int(twice[: last - 1].sum()) / n
    room = SKETCH_SD * (similarity * (1 - similarity) / n) ** 0.5
    return 2 if abs(share - similarity) <= room else int(share > similarity)


def _by_whole_sets(docs: DataFrame, doc_id: str, text: str, prints: DataFrame, unclear: DataFrame, similarity: float) -> DataFrame:
    """Those of ``unclear`` (u, v) whose sets of shingles have the similarity."""
    nodes = checkpoint(unclear.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    ids = checkpoint(prints.join(bounded(nodes, nodes.count()), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "seq")).alias("w")).select("w.*"))
    made = text_udf(_sequence, {"seq": "string"})(F.col("text"))["seq"]
    texts = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("text")).join(bounded(ids, ids.count()), F.col("k").eqNullSafe(F.col("doc_id")))
    texts = texts.withColumn("made", made).where("made = seq").groupBy(_node(F.col("seq")).alias("node")).agg(F.min("text").alias("text"))
    sets = checkpoint(texts.select("node", text_udf(_sets, {"set": "array<bigint>"})(F.col("text"))["set"].alias("set")))
    both = unclear.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return checkpoint(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))


def similar_groups(docs: DataFrame, *, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", tile_rows: int = STAGE_ROWS) -> DataFrame:
    """(doc_id, seq, head) of every row: groups of texts with this similarity of their sets of five-word shingles.

    ``seq`` is a hash of the word sequence, ``head`` the smallest id of the
    group. Equal sequences are one group. Different ones meet in blocks of texts
    that share one of their 16 smallest shingle hashes: two sets of similarity
    0.8 share none with a chance of 0.2 ** 16. In a block their 256-bit
    fingerprints are compared. A distance three standard deviations below that
    of ``similarity`` is a link, one as far above it is none. Between the two,
    every pair that these links leave apart is decided by the sets of shingles
    themselves, where their rows meet in a task: rows in doubt carry sketches
    there, and only links that hold leave it. Pairs of sets larger than their
    sketches that these leave open are decided by the whole sets. Texts without
    words are one group.
    """
    wide = {"seq": "string", "size": "int", "f": "array<bigint>", "blocks": "array<bigint>", "sketch": "binary"}
    prints = docs.select(F.col(doc_id).alias("doc_id"), text_udf(_wide, wide)(F.col(f"`{text}`")).alias("w"))
    # Parquet, since the sketches are read only where pairs are in doubt
    prints = written(prints.select("doc_id", "w.*").withColumn("node", _node(F.col("seq"))), "prints")
    words = [F.element_at("f", w + 1).alias(f"f{w}") for w in range(WIDE_WORDS)]
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("size", "f", "blocks")).alias("w"))
    nodes = checkpoint(nodes.select("node", "least", "w.*"))
    points = nodes.select(F.explode("blocks").alias("block"), "node", "size", *words)
    mean, sd = wide_distance(similarity)
    bits = {"radius": round(mean - 3 * sd), "doubt": round(mean + 3 * sd)}
    found = written(near_links(points, words=WIDE_WORDS, tile_rows=tile_rows, similarity=similarity, **bits), "near")
    links = found.where("v IS NOT NULL").select("u", "v")
    roots = checkpoint(connected_components(links))
    marks = found.where("v IS NULL").select(F.col("u").alias("node"), "side", *CELL)
    doubted = checkpoint(marks.select("node").distinct())
    n_doubted = doubted.count()
    if n_doubted:
        mine = prints.join(bounded(doubted, n_doubted), "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "f", "sketch")])
        pop = sum((F.bit_count(f"f{w}") for w in range(1, WIDE_WORDS)), F.bit_count("f0")).cast("int")
        mine = written(mine.join(roots, "node", "left").select("node", "size", "sketch", F.coalesce("root", "node").alias("label"), *words).withColumn("pop", pop), "doubted")
        run = _decided(bits["radius"], WIDE_WORDS, bits["doubt"], similarity)
        got = written(_dealt(marks.join(mine, "node")).mapInArrow(run, "u bigint, v bigint, sure boolean"), "decided")
        links = links.unionByName(got.where("sure").select("u", "v"))
        roots = checkpoint(connected_components(links))
        ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("u", "v")]
        unclear = got.where("NOT sure").select("u", "v").distinct().join(ends[0], "u", "left").join(ends[1], "v", "left")
        unclear = checkpoint(unclear.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))
        if unclear.limit(1).count():
            roots = checkpoint(connected_components(links.unionByName(_by_whole_sets(docs, doc_id, text, prints, unclear, similarity))))
    linked = checkpoint(nodes.select("node", "least").join(roots, "node"))
    heads = checkpoint(linked.groupBy("root").agg(F.min("least").alias("head")))
    moved = checkpoint(linked.join(bounded(heads, heads.count()), "root").select("node", "head"))
    heads = checkpoint(nodes.select("node", "least").join(bounded(moved, moved.count()), "node", "left").select("node", F.coalesce("head", "least").alias("head")))
    return prints.select("doc_id", "seq", "node").join(heads, "node").select("doc_id", "seq", "head")


def _sets(texts: pa.Array) -> dict[str, pa.Array]:
    return {"set": pa.array([_set(t).view(np.int64) for t in text_bytes(texts)], pa.list_(pa.int64()))}


def _sequence(texts: pa.Array) -> dict[str, pa.Array]:
    return {"seq": pa.array([_sequence_hash(t) for t in text_bytes(texts)], pa.string())}


def drop_similar(docs: DataFrame, *, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts, the one of the smallest id, all columns kept.

    Of repeated rows (equal ids and equal word sequences) one stays, and one of
    a group that has no ids.
    """
    groups = similar_groups(docs, similarity=similarity, doc_id=doc_id, text=text)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    stay = checkpoint(stay)
    key, seq, made = free_name(docs, "kept_id"), free_name(docs, "kept_seq"), free_name(docs, "made_seq")
    marked = docs.withColumn(made, text_udf(_sequence, {"seq": "string"})(F.col(f"`{text}`"))["seq"])
    kept = marked.join(
        stay.select(F.col("doc_id").alias(key), F.col("seq").alias(seq)),
        (F.col(made) == F.col(seq)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(key)), "left_semi",
    )
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id, made])
    return kept.drop(made)
