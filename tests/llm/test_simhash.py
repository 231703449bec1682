"""SimHash near-duplicates: fingerprints, tiles, components, and the stage on similar texts."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import components, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("tile_rows", [5, 40, 16_384])
def test_links_equal_brute_force(spark, tile_rows):
    """Chains, cliques, equal fingerprints, and pairs just within and beyond the radius, also where blocks are cut into many tiles."""
    rng = random.Random(tile_rows)
    prints, k = {}, 0
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 25])):
            prints[k] = fp = near(rng, fp, rng.choice([0, 1, 2, 3, 4]))
            k += 1
    hub = rng.getrandbits(64)
    for _ in range(60):
        prints[k] = near(rng, hub, rng.choice([1, 2]))
        k += 1
    points = spark.createDataFrame([(i, signed(f)) for i, f in prints.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.link_fingerprints(points, tile_rows=tile_rows).collect()}
    assert got == brute_components(prints)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["A", "b", "É", "x\ty", "lorem"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "one", "one two", "one two three", " y" * 5000]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r.component_id for k, r in got.items()} == brute_components({k: brute_fingerprint(t) for k, t in enumerate(texts)})


def test_majority_over_many_pieces():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 70_000, 0, 3, 131_073, 0]
    h = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    got = simhash.majority_bits(h, np.cumsum(sizes))
    start = 0
    for k, n in enumerate(sizes):
        part = h[start : start + n]
        want = sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n) if n else 0
        assert int(got[k, 0]) == want
        start += n


def test_large_cells_find_what_small_ones_find(monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = np.array([near(rng, rng.choice(base), rng.choice([1, 2, 5])) for _ in range(300)], np.uint64)
    pop = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    args = (np.zeros(300, np.int64), np.full(300, -1), pop[order], fps[order][:, None], 3)
    a = simhash.compare_cells(*args)[0]
    monkeypatch.setattr(simhash, "SMALL", 1000)
    b = simhash.compare_cells(*args)[0]
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "SQUARE", 7)
    c = simhash.compare_cells(*args)[0]
    assert (a == b).all() and (a == c).all()


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_equal_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    adjacent = {}
    for a, b in edges:
        if a is not None and a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    want = {}
    for n in adjacent:
        seen, todo = {n}, [n]
        while todo:
            for x in adjacent[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[n] = min(seen)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def similar(a, b):
    x, y = (set(simhash.shingle_hashes((t or "").encode(), 5)) for t in (a, b))
    return x == y if not x or not y else len(x & y) >= 0.8 * len(x | y)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("tile_rows", [10, 16_384])
def test_similar_texts_equal_brute_force(spark, tile_rows):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120, 300]))]
        texts += [edited(rng, words, e) for e in (0, 0, 1, 2, rng.randint(3, 12))]
    shared = "this passage of ten words stands in many of them"
    texts += [f"{shared} {' '.join(f'u{rng.randrange(5000)}' for _ in range(40))}" for _ in range(40)] + [None, "", " ", "one two", "One  two"]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.head for r in simhash.similar_groups(docs, tile_rows=tile_rows).collect()}
    assert got == want
    kept = simhash.drop_similar(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_edges(odd, empty):
    rows = simhash.near_duplicates(odd("component_id")).collect()
    assert len(rows) == 10
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {0}  # texts without words link like any other
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6} and [r.component_id for r in rows if r.doc_id == 3] == [3, 3]
    assert simhash.near_duplicates(empty).count() == 0
    docs = odd("made_seq")
    kept = simhash.drop_similar(docs).collect()
    assert [c for c in docs.columns] == kept[0].__fields__
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 0, 3, 4, 5, 6]
    assert simhash.drop_similar(empty).count() == 0
