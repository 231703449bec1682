"""Secret scans by a randomness test battery.

Three fixed patterns find the secrets whose shape is known. Beside them, every
run of 20 or more characters of the base64 family is a candidate. The smallest
encoding that holds all its characters is inferred, and three tests run over
that encoding's symbols:

* chi-squared uniformity of the alphabet. Its statistic is turned into the
  chance that ordinary text of that length looks at least as uniform: for text
  the statistic is about non-central chi-squared, with a non-centrality that
  grows with the length, so short candidates can't get small p-values;
* a runs test on character classes (or above/below the middle symbol). Words,
  paths and numbers change class rarely, random strings often, so this test too
  gives a chance of text (where the alphabet has several classes);
* the lag-one serial correlation of the symbols.

The chances that text is as uniform and changes class as often are combined by
the sum of their normal scores. A candidate that fails the runs or the serial
test as a random string has p = 1. False discoveries are controlled over the
whole corpus, separately for each encoding and length class (Benjamini-Hochberg
on a fixed grid of p-values whose counts are a small table), so that strings
that are easily told, or encodings that are full of ordinary names, don't
change what is found among the others.
"""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, text_strs, text_udf

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A run and its maximal match are the same thing for these two, so the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Every assign match holds one of these in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, alphabet, from the smallest up, and of ordinary text written in it: the sum of squared symbol shares, and the share of
#: characters of another class than the one before (0: an alphabet of one class, whose runs say nothing about text).
ENCODINGS = (
    ("decimal", _DIGITS, 0.135, 0.0),
    ("hex", _DIGITS + "abcdef", 0.10, 0.2),
    ("hex_upper", _DIGITS + "ABCDEF", 0.10, 0.2),
    ("base32", _UPPER + "234567", 0.066, 0.1),
    ("base36", _DIGITS + _LOWER, 0.066, 0.12),
    ("base36_upper", _DIGITS + _UPPER, 0.066, 0.12),
    ("base62", _DIGITS + _UPPER + _LOWER, 0.055, 0.36),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 0.055, 0.35),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", 0.055, 0.35),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_=", 0.055, 0.35),
)
_INDEX = [({c: i for i, c in enumerate(alphabet)}, share, changes) for _, alphabet, share, changes in ENCODINGS]

#: Candidates have at least this many characters.
SHORTEST = 20
#: Length classes: 20-23, 24-31, 32-39, 40-63, 64-127, 128 and more.
LENGTHS = (24, 32, 40, 64, 128)
#: p-values are kept on a grid of powers of 10 ** -0.25; the grid ends at 1e-50.
GRID, GRID_STEPS = 0.25, 200
#: Runs and serial tests reject randomness beyond this many standard deviations.
REJECT_Z = 3.3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three known shapes, leftmost and without overlap within a kind."""
    spans = []
    if text:
        low = text.lower()
        if any(h in low for h in ASSIGN_HINTS):
            spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def length_class(n: int) -> int:
    return bisect.bisect_right(LENGTHS, n)


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@dataclass(frozen=True)
class Battery:
    encoding: str
    number: int  # of the encoding
    chi2: float
    runs_z: float
    serial_z: float
    p: float


def battery(token: str) -> Battery:
    """The tests on one candidate. Trailing ``=`` padding doesn't count."""
    s = token.rstrip("=") or token
    used = set(s)
    number, (index, share, text_changes) = next((k, x) for k, x in enumerate(_INDEX) if used <= x[0].keys())
    n, k = len(s), len(index)
    symbols = [index[c] for c in s]
    counts: dict[int, int] = {}
    for x in symbols:
        counts[x] = counts.get(x, 0) + 1
    chi2 = sum(c * c for c in counts.values()) * k / n - n
    shift = (n - 1) * (k * share - 1)  # of the statistic's mean, for text
    uniform_z = ((k - 1) + shift - chi2) / math.sqrt(2 * (k - 1) + 4 * shift)

    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in s]
    of_class = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if len(set(kinds)) < 2:
        kinds = ["h" if 2 * x >= k else "b" for x in symbols]
    same = sum(v * (v - 1) for v in (kinds.count(t) for t in set(kinds))) / (n * (n - 1)) if n > 1 else 1.0
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    runs_sd = math.sqrt(max((n - 1) * same * (1 - same), 1e-9))
    runs_z = (changes - (n - 1) * (1 - same)) / runs_sd
    scores = [uniform_z]
    if text_changes and n > 1:
        scores.append((of_class - (n - 1) * text_changes) / math.sqrt((n - 1) * text_changes * (1 - text_changes)))
    p = _phi(-sum(scores) / math.sqrt(len(scores)))

    mean = sum(symbols) / n
    around = [x - mean for x in symbols]
    total = sum(x * x for x in around)
    serial_z = (sum(a * b for a, b in zip(around, around[1:])) / total * n + 1) / math.sqrt(n) if total else float(n)
    if abs(runs_z) > REJECT_Z or abs(serial_z) > REJECT_Z:
        p = 1.0
    return Battery(ENCODINGS[number][0], number, chi2, runs_z, serial_z, p)


def grid_step(p: float) -> int:
    """The largest step g with p <= 10 ** (-GRID * g)."""
    return min(GRID_STEPS, int(-math.log10(max(p, 1e-300)) / GRID + 1e-9)) if p > 0 else GRID_STEPS


def outside(start: int, end: int, base: list[tuple[int, int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The stretches of start..end outside the spans ``base`` (by start), and from which span on the next stretch has to look.

    Spans before ``at`` end before ``start``; successive calls go through the spans once.
    """
    while at < len(base) and base[at][1] <= start:
        at += 1
    left, k = [], at
    while k < len(base) and base[k][0] < end:
        if base[k][0] > start:
            left.append((start, base[k][0]))
        start = max(start, base[k][1])
        k += 1
    if start < end:
        left.append((start, end))
    return left, at


def candidates(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, group, grid step) of every candidate; what spans of known shapes leave of one is a candidate if it is long enough.

    A group is an encoding and a length class.
    """
    found, at = [], 0
    reach: list[tuple[int, int, int]] = []  # the spans, joined where they overlap
    for s, e, k in base or ():
        if reach and s < reach[-1][1]:
            reach[-1] = (reach[-1][0], max(e, reach[-1][1]), k)
        else:
            reach.append((s, e, k))
    for m in CANDIDATE.finditer(text):
        pieces, at = outside(m.start(), m.end(), reach, at) if reach else ([m.span()], 0)
        for start, end in pieces:
            if end - start >= SHORTEST:
                token = text[start:end]
                b = battery(token)
                found.append((start, end, group_of(b.number, len(token.rstrip("=") or token)), grid_step(b.p)))
    return found


def group_of(encoding: int, n: int) -> int:
    return encoding * (len(LENGTHS) + 1) + length_class(n)


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Per group the least grid step that Benjamini-Hochberg rejects at; groups with none are absent."""
    out = {}
    for cls in {c for c, _ in counts}:
        steps = {g: n for (c, g), n in counts.items() if c == cls}
        total, above = sum(steps.values()), 0
        for g in range(GRID_STEPS, 0, -1):
            above += steps.get(g, 0)
            if above and 10 ** (-GRID * g) * total <= rate * above:
                out[cls] = g
    return out


def _scan(texts: pa.Array) -> dict[str, pa.Array]:
    spans, found = [], []
    for text in text_strs(texts):
        base = base_spans(text)
        spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in base])
        found.append([{"start": s, "end": e, "group": c, "step": g} for s, e, c, g in candidates(text, base)])
    return {
        "base": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        "found": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("group", pa.int32()), ("step", pa.int32())]))),
    }


_SCHEMA = {
    "base": "array<struct<kind:string,start:bigint,end:bigint>>",
    "found": "array<struct<start:bigint,end:bigint,group:int,step:int>>",
}


def _least(docs: DataFrame, text: str, rate: float) -> dict[int, int]:
    """The thresholds of all of ``docs``."""
    tests = docs.select(F.explode(text_udf(_scan, _SCHEMA)(F.col(f"`{text}`"))["found"]).alias("t"))
    counts = {(r[0], r[1]): r[2] for r in tests.groupBy("t.group", "t.step").count().collect()}
    return thresholds(counts, rate)


def scan_secrets(docs: DataFrame, *, text: str = "text", rate: float = 0.01, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: array<struct<kind, start, end>>, by start and then in the order of ``KINDS``.

    Offsets are code points, ends exclusive. ``rate`` is the false-discovery
    rate of the added ``random`` spans in each group, over all of ``docs``; spans
    of known shapes are cut out of the candidates, and what is left and long
    enough is tested. A null or empty text, and an empty table, have no spans. A
    text longer than any bound is scanned whole. The corpus is read twice: once
    for the table of p-values (at most 60 x 201 counts) and once for the spans.
    """
    scan = text_udf(_scan, _SCHEMA)
    least = _least(docs, text, rate)
    tmp = free_name(docs, "scan")
    passes = lambda c: F.lit(False)
    if least:
        passes = lambda c: F.coalesce(
            *[F.when(c["group"] == cls, c["step"] >= g) for cls, g in sorted(least.items())], F.lit(False)
        )
    span = lambda k: lambda c: F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    order = lambda c: F.struct(c["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("k"), c["end"].alias("end"), c["kind"].alias("kind"))
    every = F.concat(F.col(tmp)["base"], F.transform(F.filter(F.col(tmp)["found"], passes), span("random")))
    every = F.transform(F.array_sort(F.transform(every, order)), lambda c: F.struct(c["kind"], c["start"], c["end"]))
    return docs.withColumn(tmp, scan(F.col(f"`{text}`"))).withColumn(into, every).drop(tmp)


def hide(text: str, spans: list[dict], mark: str = "<secret>") -> str:
    """The text with ``mark`` in place of each joined stretch of spans, which come by start."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += (text[at : s["start"]], mark)
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _redact(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([hide(t, s) if s and t is not None else t for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())


def redact(docs: DataFrame, *, text: str = "text", spans: str = "secrets") -> DataFrame:
    """``docs`` with every character inside a span gone and ``<secret>`` in place of each joined stretch.

    A null text stays null, a text without spans (or with null spans) as it is.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(text, F.arrow_udf(_redact, "string")(F.col(f"`{text}`"), F.col(f"`{spans}`")))


def redact_secrets(docs: DataFrame, *, text: str = "text", rate: float = 0.01, into: str = "redacted") -> DataFrame:
    """What ``redact`` makes of ``scan_secrets``, and ``into``: whether the text had a secret.

    A text is scanned and redacted in one go: two Python workers in a row would
    be two processes a task, which Spark keeps for all that follows.
    """
    least = _least(docs, text, rate)

    def clean(texts: pa.Array) -> dict[str, pa.Array]:
        out, changed = [], []
        for t in texts.to_pylist():
            base = base_spans(t or "")
            more = [(s, e) for s, e, c, g in candidates(t or "", base) if c in least and g >= least[c]]
            spans = sorted([(s, e) for s, e, _ in base] + more)
            out.append(hide(t, [{"start": s, "end": e} for s, e in spans]) if spans else t)
            changed.append(bool(spans))
        return {"text": pa.array(out, pa.string()), "changed": pa.array(changed, pa.bool_())}

    tmp = free_name(docs, f"{into}_made")
    made = docs.withColumn(tmp, text_udf(clean, {"text": "string", "changed": "boolean"})(F.col(f"`{text}`")))
    return made.withColumn(text, F.col(tmp)["text"]).withColumn(into, F.col(tmp)["changed"]).drop(tmp)
