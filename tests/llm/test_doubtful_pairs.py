"""The near-duplicate stage on families of copies whose pairs lie around the threshold."""

import random

from tessera.llm import simhash


def family(seed, n=100):
    """A text and copies of copies, each with some words changed."""
    rng = random.Random(seed)
    out = [[f"w{rng.randrange(10_000)}" for _ in range(150)]]
    while len(out) < n:
        words = list(rng.choice(out))
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(100_000)}"
        out.append(words)
    return [" ".join(w) for w in out]


def brute_groups(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    head = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if head[i] != head[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((head[i], head[j]))
                head = [low if h == high else h for h in head]
    return dict(enumerate(head))


def test_no_pair_is_lost_behind_one_that_fails(spark):
    texts = [t for seed in range(4) for t in family(seed)]
    want = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile_rows in (30, simhash.STAGE_ROWS):
        got = {r.doc_id: r.head for r in simhash.similar_groups(docs, tile_rows=tile_rows).collect()}
        assert len(set(want.values())) > 4 and got == want
