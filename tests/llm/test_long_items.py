"""Edited benchmark items of any length are found."""

import random

import pytest

from tessera.llm import decontaminate


def edited(rng, words, edits):
    """That many words changed, left out or put in, at different places."""
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        words[at : at + 1] = rng.choice(([f"e{rng.randrange(9_999)}"], [], [f"e{rng.randrange(9_999)}", words[at]]))
    return words


def recall(length, share, trials, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(3_000 * rng.random() ** 2)}"
    items = [[word() for _ in range(length)] for _ in range(trials)]
    index = decontaminate.Index([(k, " ".join(x).encode()) for k, x in enumerate(items)])
    texts = []
    for x in items:
        body = edited(rng, x, int(share * length))
        texts.append(" ".join([word() for _ in range(rng.randrange(90))] + body + [word() for _ in range(60)]).encode())
    return sum(any(f["item"] == k for f in found) for k, found in enumerate(decontaminate.find_items(index, texts))) / trials


@pytest.mark.parametrize("length", [60, 100, 200, 400])
def test_recall_holds_for_long_items(length):
    assert recall(length, 0.1, 60) >= 0.97 and recall(length, 0.2, 60) >= 0.9


def test_parts_cover_an_item():
    for n in range(1, 300):
        parts = decontaminate.parts_of(n)
        size = n if n <= decontaminate.WHOLE else decontaminate.PART
        assert {w for p in parts for w in range(p, p + size)} == set(range(n)) and len(set(parts)) == len(parts)


if __name__ == "__main__":
    for n in (20, 40, 60, 100, 200, 400):
        print(n, *(round(recall(n, s, 150), 3) for s in (0.05, 0.1, 0.15, 0.2)), flush=True)
