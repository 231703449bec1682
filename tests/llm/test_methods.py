"""Dealt methods against plain versions of themselves."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, language_id, license_scan, secret_scan, simhash


def brute_secrets(texts, rate=0.01):
    """Spans by character sets: what the known shapes leave of each candidate, tested and rejected group by group."""
    base, pieces = [], []
    for i, text in enumerate(texts):
        spans = secret_scan.base_spans(text)
        base.append([(secret_scan.KINDS[k], s, e) for s, e, k in spans])
        covered = {j for s, e, _ in spans for j in range(s, e)}
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            run = []
            for j in range(m.start(), m.end() + 1):
                if j < m.end() and j not in covered:
                    run.append(j)
                elif run:
                    if len(run) >= 20:
                        pieces.append((i, run[0], run[-1] + 1))
                    run = []
    tested = []
    for i, s, e in pieces:
        token = texts[i][s:e]
        b = secret_scan.battery(token)
        tested.append((b.encoding, secret_scan.length_class(len(token.rstrip("=") or token)), secret_scan.grid_step(b.p), i, s, e))
    for group in {x[:2] for x in tested}:
        steps = sorted((x[2] for x in tested if x[:2] == group), reverse=True)
        fine = [g for k, g in enumerate(steps, 1) if g > 0 and 10 ** (-0.25 * g) * len(steps) <= rate * sum(x >= g for x in steps)]
        for x in tested:
            if x[:2] == group and fine and x[2] >= min(fine):
                base[x[3]].append(("random", x[4], x[5]))
    order = {k: n for n, k in enumerate(secret_scan.KINDS)}
    return [sorted(b, key=lambda s: (s[1], order[s[0]])) for b in base]


def test_secret_spans_equal_brute_force(spark):
    rng = random.Random(11)
    rand = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    full, made = string.ascii_letters + string.digits, []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts.append(rng.choice([
                lambda: rand(full, rng.randint(18, 70)), lambda: rand(string.digits + "ABCDEF", 32), lambda: "AKIA" + rand(string.ascii_uppercase, 17) + "+" + rand(full + "+", 35),
                lambda: "token=" + rand(full, 12), lambda: rand("0123456789abcdef", 30) + "Z" + rand(full, 40), lambda: "_".join(rng.choice(["user", "name", "value", "index"]) for _ in range(6)), lambda: "plain words",
            ])())
        made.append(rng.choice([" ", ",", "é"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.secrets] for r in secret_scan.scan_secrets(docs).collect()}
    want = brute_secrets(made)
    assert all(got[k] == want[k] for k in range(len(made)))
    assert sum(s[0] == "random" for x in want for s in x) > 100
    clean = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan_secrets(docs)).collect()}
    for k, text in enumerate(made):
        hidden = {j for _, s, e in want[k] for j in range(s, e)}
        assert clean[k].replace("<secret>", "") == "".join(c for j, c in enumerate(text) if j not in hidden)


def test_many_secrets_in_one_text_take_linear_time():
    rng = random.Random(12)
    text = " ".join("token=" + "".join(rng.choice(string.ascii_letters) for _ in range(30)) + " " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30)) for _ in range(20_000))
    base = secret_scan.base_spans(text)
    found = secret_scan.candidates(text, base)
    assert len(base) == len(found) == 20_000
    spans = sorted([{"start": s, "end": e} for s, e, _ in base] + [{"start": s, "end": e} for s, e, *_ in found], key=lambda s: s["start"])
    assert secret_scan.hide(text, spans).count("<secret>") == 40_000


def test_language_cosines_equal_brute_force(spark):
    rng = random.Random(13)
    rows = [(k, "".join(rng.choice("abcde fgh" if k % 2 else "hgf éüö") for _ in range(60)), "x" if k % 2 else "y") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.prototypes(docs)

    def vector(text):
        out = np.zeros(1024, np.int64)
        words = re.findall(r"[^\W\d_]+", text)
        line = " " + " ".join(words) + " " if words else ""
        one = lambda c: language_id.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint32))[0].astype(np.int64)
        for a, b, c in zip(line, line[1:], line[2:]):
            if b != " ":
                out += np.roll(one(a), 2) * np.roll(one(b), 1) * one(c)
        return out

    for lang in ("x", "y"):
        assert np.array_equal(known[lang], sum(vector(t) for _, t, x in rows if x == lang))
    unit = lambda v: v / np.linalg.norm(v)
    for r in language_id.predict(docs, known).collect():
        cosines = {x: float(unit(vector(r.text)) @ unit(known[x])) for x in known}
        assert r.lang_pred == max(sorted(cosines), key=cosines.get) and abs(r.score - max(0, cosines[r.lang_pred])) < 1e-4


def test_scripts_of_many_letters_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(14)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))
    tracemalloc.start()
    grams = language_id.Trigrams([text])
    got = grams.bundles(np.zeros(1, np.int64), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grams.keys) > 190_000 and np.any(got) and peak < 200 << 20


def test_licence_probabilities_equal_brute_force():
    rng = random.Random(15)
    words = "plain words of no licence whatever and more under the version work is permission software".split()
    model = license_scan.fit([" ".join(rng.choice(words) for _ in range(12)).encode() for _ in range(200)])
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["Released under the MIT License."]
    raw = "\n".join(lines).encode()
    hashes, starts = license_scan.word_hashes(raw)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)
    a, b, _, _ = license_scan._units(line)
    got = license_scan._sums(model, hashes, line, a, b)
    for k in range(0, len(a), 7):
        want = np.zeros(len(license_scan.FAMILIES))
        for n in (1, 2, 3):
            buckets = license_scan.grams(hashes, n, line)
            for j in range(a[k], b[k] - n + 1):
                want += model.weights[buckets[j]]
        assert np.allclose(got[k], want, atol=1e-4)
    # every word hashes alike wherever it stands, and words are those of the pattern
    assert [bytes(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*", raw.lower())] and len(hashes) == len(re.findall(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*", raw.lower()))
    assert len(set(hashes.tolist())) == len({w.lower().strip(".") for x in lines for w in x.split()})


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(16)
    base = "word of plain prose about the old river and the town that nobody left while summer came again with rain".split()
    prose = lambda n: " ".join(rng.choice(base) for _ in range(n))
    return license_scan.fit([prose(rng.randint(3, 40)).encode() for _ in range(400)]), prose


def test_licence_texts(licence_model):
    import textwrap

    model, prose = licence_model
    template = lambda name, k: [t for f, t in license_scan.TEMPLATES if f == name][k]
    scan = lambda t: [(x["line"], x["last_line"], x["family"], x["confirmed"]) for x in license_scan.scan_paragraphs(model, [t.encode()])[0]]
    assert scan(template("gpl-2.0", 1) + ", or (at your option) any later version.") == [(0, 0, "gpl-2.0", True)]
    sure = lambda t: [x for x in scan(t) if x[3]]
    assert not sure("The film was released last year under the new director, and the MIT campus gave a license fee")
    assert not sure(f"this {prose(400)} work {prose(400)} is {prose(400)} licensed under the {prose(300)} cc {prose(300)} by 4.0")
    assert scan("SPDX-License-Identifier: MIT") == [(0, 0, "mit", True)] and scan("Released under the ISC License.") == [(0, 0, "isc", True)]
    assert scan(template("epl-2.0", 0)) == [(0, 0, "epl-2.0", True)] and scan(template("unlicense", 0)) == [(0, 0, "unlicense", True)] and scan(template("zlib", 0)) == [(0, 0, "zlib", True)]
    wrapped = textwrap.fill(template("mit", 1), 76)
    assert scan(wrapped) == [(0, wrapped.count("\n"), "mit", True)]
    assert [x[2:] for x in scan(" * " + textwrap.fill(template("gpl-3.0", 1), 70).replace("\n", "\n * "))] == [("gpl-3.0", True)]
    assert [x[2:] for x in scan(f"{prose(200)} Licensed under the Apache License, Version 2.0. {prose(200)}")] == [("apache-2.0", True)]


def test_sketches_decide_as_sets_do():
    rng = np.random.default_rng(17)
    for n in (5, 60, 1000, 1500, 6000):
        for _ in range(40):
            share = rng.choice([0.5, 0.7, 0.78, 0.8, 0.82, 0.95])
            both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            common = len(np.intersect1d(a, b))
            want = int(common >= 0.8 * (len(a) + len(b) - common))
            got = simhash.by_sketch(simhash._sketch(a), len(a), simhash._sketch(b), len(b), 0.8)
            assert got == want or (got == 2 and n > simhash.SKETCH)


def test_squares_decide_as_pairs_do(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 100)
    rng = np.random.default_rng(20)
    base = rng.integers(0, 1 << 63, 1400, dtype=np.uint64)
    sets = []
    for k in range(60):
        keep = base[rng.random(len(base)) < rng.uniform(0.6, 1)][: 1400 if k % 10 == 0 else 900]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])))
    sketches, size = [simhash._sketch(s) for s in sets], np.array([len(s) for s in sets])
    i, j = np.triu_indices(60, 1)
    got = simhash.similar_in_square(sketches, size, i, j, 0.6)
    want = [simhash.by_sketch(sketches[a], size[a], sketches[b], size[b], 0.6) for a, b in zip(i, j)]
    assert got.tolist() == want and {0, 1} <= set(want)


def test_large_sets_in_doubt_are_decided_whole(spark):
    """Two pairs just above and just below the similarity, of more shingles than a sketch holds."""
    rng = random.Random(18)
    words = [f"w{k}" for k in range(50_000)]
    base = [rng.choice(words) for _ in range(3000)]
    rows = [(0, " ".join(base))]
    for k, cut in ((1, 2640), (2, 2700)):
        rows.append((k, " ".join(base[:cut] + [rng.choice(words) for _ in range(3000 - cut)])))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    got = {r.doc_id: r["head"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not near(0, 1) and near(0, 2) and not near(1, 2) or near(1, 2)
    assert got[2] == 0 and got[1] == (0 if near(0, 1) or near(1, 2) else 1)


def test_graded_families_equal_brute_force(spark):
    """Some hundred copies of one text with graded edits: chains whose ends are far apart."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for k in range(110):
        rows.append((k, " ".join(text)))
        if k % 3 == 2:
            text = list(text)
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    head = list(range(len(rows)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                head[max(a, b)] = min(a, b)
    for tile_rows in (16_384, 16):
        got = {r.doc_id: r["head"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile_rows=tile_rows).collect()}
        assert got == {k: top(k) for k in range(len(rows))}
    assert 1 < len({top(k) for k in range(len(rows))}) < 110


@pytest.mark.parametrize("length", [1, 5, 6, 8, 20, 32, 40, 48, 80, 120])
def test_recall_by_length(length):
    """At least 0.9 with a fifth of the words in edits, whatever an item's length."""
    rng = random.Random(length)
    words = [f"v{k}" for k in range(5000)]
    items = [[rng.choice(words) for _ in range(length)] for _ in range(100)]
    docs = []
    for item in items:
        w = list(item)
        for _ in range(length // 5):
            p, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.4:
                w[p] = rng.choice(words)
            elif kind < 0.7:
                del w[p]
            else:
                w.insert(p, rng.choice(words))
        docs.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 40))] + w + [rng.choice(words) for _ in range(rng.randint(0, 40))]).encode())
    index = decontaminate.Index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    got = decontaminate.find_items(index, docs)
    held = [i for i, d in enumerate(docs) if decontaminate.best_stretch(index.items[i], [index.vocabulary.get(w, 0) for w in decontaminate.words_of(d)], length // 5)]
    assert len(held) > 80 and sum(any(x["item"] == i for x in got[i]) for i in held) >= 0.9 * len(held)
    assert all(Counter(x["item"] for x in r).most_common(1)[0][1] == 1 for r in got if r)
