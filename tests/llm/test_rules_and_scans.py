"""Secret scans, quality rules, licence scans and language identification."""

import random
import re
import string
from collections import Counter

import numpy as np

from tessera.llm import language_id, license_scan, quality_rules, secret_scan


# --- secrets -----------------------------------------------------------------------------


def brute_spans(text):
    out = []
    for k, (pattern, flags, fine) in enumerate([
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]):
        out += [(m.start(), m.end(), k) for m in re.finditer(pattern, text, flags) if fine(m)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    bits = ["token", "secret=token", " = ", "'abcdef'", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP1234", "deadbeef" * 3, "API_KEY:", "é", " ", "PassWD\"=\"", "xyz", "0123456789abcdef", "=", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert secret_scan.base_spans(text) == brute_spans(text), text


def test_battery_tells_random_from_text():
    rng = random.Random(2)
    alphabet = string.ascii_letters + string.digits + "+/"
    for n in (32, 48, 64):
        ps = [secret_scan.battery("".join(rng.choice(alphabet) for _ in range(n))).p for _ in range(200)]
        assert np.median(ps) < 1e-3
    for alphabet, n in ((string.digits + "ABCDEF", 40), (string.ascii_uppercase + "234567", 40), (string.ascii_letters + string.digits, 24)):
        ps = [secret_scan.battery("".join(rng.choice(alphabet) for _ in range(n))).p for _ in range(300)]
        assert np.mean(np.array(ps) <= 1e-3) > 0.8
    words = ["donaudampfschifffahrtsgesellschaft", "ThisIsACamelCaseIdentifierNameForJava", "https/example/com/path/to/page-index", "this_is_a_very_long_snake_case_name", "0123456789012345678901234567", "a" * 40]
    assert all(secret_scan.battery(w).p > 0.05 for w in words)
    short, long = secret_scan.battery("riGp/58WAm+dX3a5IDnO"), secret_scan.battery("riGp/58WAm+dX3a5IDnOZST6IaXqA2h9Uz0+T1SaQ6dDwxlG")
    assert long.p < short.p  # the longer a random string, the surer


def test_discovery_control_keeps_the_rate():
    counts = {(0, 2): 900, (0, 30): 5, (1, 1): 1000}
    got = secret_scan.thresholds(counts, 0.01)
    assert got == {0: 18}  # the least step at which the expected share of false ones is within the rate
    assert 10 ** (-0.25 * 18) * 905 <= 0.01 * 5 < 10 ** (-0.25 * 17) * 905
    assert secret_scan.thresholds({}, 0.01) == {}


def test_scan_adds_random_spans_and_keeps_base(spark):
    rng = random.Random(3)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48))
    texts = [f"see {key} here", 'my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok', "plain words onlyandaverylongwordofletters"]
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.secrets] for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == [("random", 4, 52)] and got[1] == [("assign", 3, 52), ("hex", 12, 52)] and got[2] == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token = abcdefg end", None), (2, "clean", None), (3, None, None), (4, "token=" + "deadbeef" * 4, None)], "doc_id long, text string, extra string")
    out = secret_scan.redact(secret_scan.scan_secrets(docs)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["é <secret> end", "clean", None, "<secret>"]


def test_redaction_in_one_go(spark, odd, empty):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    hexes = "deadbeef" * 4
    texts = [f"see {key(48)} here", f"token={key(44)} and {key(44)}", f"{hexes} token = {hexes}{key(40)}", f"é api_key: {hexes}", f"{key(20)}/{key(30)}" * 3, "clean", "", None]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts * 3)], "doc_id long, text string, redacted string")
    scanned = secret_scan.scan_secrets(docs)
    hits = {r.doc_id: len(r.secrets) > 0 for r in scanned.collect()}
    told = {r.doc_id: r.text for r in secret_scan.redact(scanned).collect()}
    got = secret_scan.redact_secrets(docs)
    assert got.columns == docs.columns and {r.doc_id: r.redacted for r in got.collect()} == hits
    assert {r.doc_id: r.text for r in got.collect()} == told and sum(hits.values()) > 9 and None in told.values() and "" in told.values()
    assert all(not r.found for r in secret_scan.redact_secrets(odd("found"), into="found").collect()) and secret_scan.redact_secrets(empty).count() == 0


def test_secret_edges(odd, empty):
    rows = secret_scan.scan_secrets(odd("spans")).collect()
    assert len(rows) == 10 and all(r.secrets == [] for r in rows) and all("spans" in r.asDict() for r in rows)
    assert secret_scan.scan_secrets(empty).count() == 0


# --- quality rules -----------------------------------------------------------------------


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    return len({i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(8)})


def test_measures_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") + rng.choice("é#\n|") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "a\na\n \n \nb\na", "ü" * 5]
    got = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, brute_repeats(t))


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(k, good if k >= 95 else "short", "bad") for k in range(100)] + [(100 + k, good, f"good{k % 9}") for k in range(300)]
    kept = {r.doc_id: r.kept for r in quality_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[k] for k in range(100)) and all(kept[k] for k in range(100, 400))


def test_rates_are_shrunk_towards_the_prior(spark):
    rows = [(f"h{k}", j < k) for k in range(10) for j in range(20)] + [("one", True)]
    counts = ", ".join(f"40L AS {c}" if c == "n_words" else f"200L AS {c}" if c == "word_chars" else f"0L AS {c}" for c in quality_rules.FIELDS)
    rates = quality_rules.host_rates(spark.createDataFrame(rows, "source string, base_failed boolean").selectExpr("*", *counts.split(", "))).collect()
    assert {r.rule for r in rates} == {"base", *quality_rules.RULES} and all(r.shrunk_rate == 0 and r.high is None for r in rates if r.rule != "base")
    got = {r.host: r for r in rates if r.rule == "base"}
    raw = [sum(f for h, f in rows if h == x) / sum(h == x for h, _ in rows) for x in got]
    m = np.mean(raw)
    strength = max(m * (1 - m) / np.var(raw) - 1, 1)
    assert np.isclose(got["h3"].shrunk_rate, (3 + strength * m) / (20 + strength)) and np.isclose(got["h3"].high, m + quality_rules.WATCH_SD * (m * (1 - m) / (strength + 1)) ** 0.5)
    assert got["one"].shrunk_rate < 1 and 0 < got["h0"].shrunk_rate < 0.1


def test_watched_hosts_have_stricter_rules(spark):
    good = " ".join(f"word{k}" for k in range(40))
    hashes = good + " ###"
    rows = [(k, hashes if k % 2 else good, "noisy") for k in range(200)] + [(200 + k, hashes if k % 50 == 0 else good, f"h{k % 8}") for k in range(1600)]
    got = {r.doc_id: (r.base_failed, r.host_watched, r.kept) for r in quality_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] == (False, True, k % 2 == 0) for k in range(200))  # symbols fail documents of the watched host alone
    assert all(got[k][0] is False and got[k][2] for k in range(200, 1800) if not got[k][1]) and not all(got[k][1] for k in range(200, 1800))


def test_rule_edges(odd, empty):
    rows = quality_rules.apply_host_rules(odd("shrunk_rate")).collect()
    assert len(rows) == 10 and all(r.n_words == 0 and not r.kept for r in rows if not (r.text or "").split())
    assert next(r for r in rows if r.doc_id == 5).n_repeat_words == 30_000
    assert quality_rules.apply_host_rules(empty).count() == 0


# --- licences ----------------------------------------------------------------------------


def test_licences(spark, odd, empty):
    texts = [
        "Some prose.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Foo Public License, version 7.",
        "the version of the works that the author has", "Nothing at all", "Licensed under the Apache License, Version 2.0.\n" * 2,
    ]
    prose = [f"some plain prose number {k} about nothing in particular" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + prose)), "doc_id long, text string")
    got = {r.doc_id: [(x["line"], x["family"], x["confirmed"]) for x in r.licenses] for r in license_scan.scan_licenses(docs).collect()}
    assert got[0] == [(1, "mit", True)] and got[1] == [(0, "gpl-3.0", True)] and got[2] == [(0, "cc-by-nc", True)]
    assert got[3] == [(0, "unknown", False)] and not got[4] and not got[5] and len(got[6]) == 2
    assert not any(got[k] for k in range(len(texts), len(docs.collect())))
    rows = license_scan.scan_licenses(odd("family")).collect()
    assert len(rows) == 10 and all(r.licenses == [] for r in rows)
    assert license_scan.scan_licenses(empty).count() == 0


def test_licence_held_out_accuracy():
    prose = [f"plain words {k} of no licence whatever and more".encode() for k in range(300)]
    model = license_scan.fit(prose)
    held = license_scan.variants(6, 99, [license_scan.word_hashes(p)[0] for p in prose])
    p = model.probabilities([license_scan.row_of(w) for _, w in held])
    assert np.mean(p.argmax(axis=1) == [c for c, _ in held]) > 0.95


def test_templates_confirm_by_alignment():
    words = lambda t: license_scan.word_hashes(t.encode())[0].tolist()
    gpl3, mit = license_scan.FAMILIES.index("gpl-3.0"), license_scan.FAMILIES.index("mit")
    said = "well this work is licensed under the GNU General Public License version {} as we said"
    assert license_scan.confirm(words(said.format(3)), gpl3) == (1, 13) and license_scan.confirm(words(said.format(2)), gpl3) is None
    assert license_scan.confirm(words("released many years ago under quite another name the old license"), mit) is None


# --- languages ---------------------------------------------------------------------------


def test_languages_held_out(spark):
    rng = random.Random(6)
    sounds = {"en": ["the", "ing", "sh", "er", "ou"], "de": ["ung", "sch", "keit", "ei", "ü"], "fr": ["eau", "tion", "é", "eux", "que"]}
    rows = [(k, " ".join("".join(rng.choice(sounds[x]) for _ in range(3)) for _ in range(30)), x) for k in range(300) for x in [rng.choice(list(sounds))]]
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_vectors_are_nearly_orthogonal_and_bound_in_order():
    v = language_id.letter_vectors(np.arange(97, 123, dtype=np.uint32)).astype(int)
    dots = np.abs(v @ v.T - 1024 * np.eye(26)) / 1024
    assert dots.max() < 0.2
    a, b = (language_id.bound(language_id.Trigrams([t]).keys).astype(int)[0] for t in ("abc", "cba"))
    assert abs(a @ b) / 1024 < 0.2


def test_trigram_counts_equal_brute_force():
    texts = ["Abc abca, x!", "", "éé 12 é", "日本語 text"]
    grams = language_id.Trigrams(texts)
    table = grams.table()
    for i, t in enumerate(texts):
        s = " " + re.sub(r"[^a-zé日本語]+", " ", t.lower()).strip() + " "
        want = Counter(s[k : k + 3] for k in range(len(s) - 2) if s[k + 1] != " ")
        got = {"".join(chr(c) if c else " " for c in key): n for key, n in zip(grams.keys, table[i]) if n}
        assert got == want, t


def test_language_edges(odd, empty, spark):
    out = language_id.identify_languages(odd("lang_pred")).collect()
    assert len(out) == 10 and all(r.lang_pred == "und" for r in out if not any(c.isalpha() for c in r.text or ""))
    assert language_id.identify_languages(empty).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify_languages(nothing).collect()] == ["und"]
