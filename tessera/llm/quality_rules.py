"""Quality rules of documents, judged together by host.

Per document a rule either fails or not. Failures of every rule are summed by
host (which combines before it shuffles, so a host with a third of all rows
sends one row a task), each host's rate of each rule is shrunk by a beta prior
fitted to the hosts by moments, and the verdict is joined back: a host whose
documents mostly fail is rejected, and one whose shrunk rate of any rule lies
beyond an upper quantile of that rule's prior is watched, which means that its
documents have to pass the rules that elsewhere only count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, text_bytes, text_udf, with_struct

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host is rejected if its shrunk rate of documents that fail the base rules exceeds this.
HOST_RATE = 0.5
#: A host is watched if a shrunk rate lies this many standard deviations of the prior above its mean: the upper tenth of a normal.
WATCH_SD = 1.2815515655446004
#: What makes documents of a watched host fail, beside the base rules: symbols, equal lines, repeats, word lengths.
RULES = {
    "symbols": "20 * n_symbols > n_words", "lines": "10 * n_dup_lines > n_words", "repeats": "100 * n_repeat_words > 10 * n_words",
    "lengths": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
#: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle, whose hot hosts AQE splits.
BROADCAST_HOSTS = 50_000

FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_BREAKS = b" \t\n\x0b\x0c\r"
#: Continuation bytes of UTF-8, and white space: what is left of a text without them is one byte a code point of a word.
_UNCOUNTED = bytes(range(0x80, 0xC0)) + _BREAKS
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, how many of its words stand in a window of eight that occurs in it twice or more.

    ``hashes``: 64-bit hashes of all words, document after document; ``doc``:
    the document of each. Windows are compared by a 64-bit combination of
    those; two different windows of one document meet with a chance of 2**-64.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 1:
        return np.zeros(n_docs, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * _MULTIPLIERS[k]
    whole = doc[:n] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    key = key[at]
    key ^= doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int32)
    starts = at[order[twice]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(_BREAKS)]
    return len(lines) - len(set(lines))


def _measure(texts: pa.Array) -> dict[str, pa.Array]:
    raw = text_bytes(texts)
    words = [t.split() for t in raw]
    n = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    hashes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    doc = np.repeat(np.arange(len(raw)), n)
    return {
        "n_words": pa.array(n),
        "word_chars": pa.array([len(t.translate(None, _UNCOUNTED)) for t in raw], pa.int64()),
        "n_symbols": pa.array([len(t.translate(None, _NOT_SYMBOLS)) for t in raw], pa.int64()),
        "n_dup_lines": pa.array([duplicate_lines(t) for t in raw], pa.int64()),
        "n_repeat_words": pa.array(repeated_words(hashes, doc, len(raw))),
    }


def measure(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the five counts, and ``base_failed``. A null or empty text has zeros and fails (too few words)."""
    out = with_struct(docs, text_udf(_measure, FIELDS)(F.col(f"`{text}`")), list(FIELDS))
    return out.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def host_rates(measured: DataFrame, *, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """One row a host and rule: host, rule, n_docs, n_failed, shrunk_rate, high. A null host is a host of its own.

    Rules are ``base`` and those of ``RULES``. A rule's prior has the mean m and
    variance v of the hosts' raw rates, hosts weighing alike; its strength is
    m (1 - m) / v - 1, at least 1, or 1e9 if all hosts have one rate.
    shrunk_rate = (n_failed + strength * m) / (n_docs + strength); ``high`` is m
    and ``WATCH_SD`` standard deviations of the prior, null if all hosts have one rate.
    """
    rules = {"base": F.col(failed)} | {name: F.expr(rule) for name, rule in RULES.items()}
    sums = [F.sum(r.cast("bigint")).alias(f"rule_{name}") for name, r in rules.items()]
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *sums)
    hosts = checkpoint(hosts)  # the texts are measured once for this
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"rule_{name}").alias("n_failed")) for name in rules]))
    hosts = hosts.select("host", "n_docs", each.alias("r")).select("host", "r.rule", "n_docs", "r.n_failed")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))  # one row a rule
    strength = F.when(F.col("v") <= 1e-12, F.lit(1e9)).otherwise(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)))
    out = hosts.join(F.broadcast(prior.withColumn("s", strength)), "rule")
    high = F.when(F.col("v") > 1e-12, F.col("m") + WATCH_SD * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1)))
    return out.select("host", "rule", "n_docs", "n_failed", ((F.col("n_failed") + F.col("s") * F.col("m")) / (F.col("n_docs") + F.col("s"))).alias("shrunk_rate"), high.alias("high"))


def apply_host_rules(docs: DataFrame, *, text: str = "text", host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``host_watched`` and ``kept``.

    ``kept`` is false where the document fails the base rules itself, where its
    host's shrunk rate of such documents exceeds ``host_rate``, or where its
    host is watched and it fails one of ``RULES``. An empty table gives an empty
    result. Hosts are counted before the join: up to ``BROADCAST_HOSTS``
    verdicts are broadcast, more are joined by a shuffle.
    """
    measured = measure(docs, text=text)
    name, rejected, watched = (free_name(measured, x) for x in ("bad_host", "host_rejected", "host_seen"))
    rates = host_rates(measured, host=host).groupBy(F.col("host").alias(name)).agg(
        F.max((F.col("rule") == "base") & (F.col("shrunk_rate") > host_rate)).alias(rejected),
        F.coalesce(F.max(F.col("shrunk_rate") > F.col("high")), F.lit(False)).alias(watched),
    )
    bad = checkpoint(rates.where(F.col(rejected) | F.col(watched)))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = measured.join(bad, F.col(f"`{host}`").eqNullSafe(F.col(name)), "left")
    strict = F.expr(" OR ".join(f"({rule})" for rule in RULES.values()))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = ~F.col("base_failed") & ~yes(rejected) & ~(yes(watched) & strict)
    return joined.withColumn("kept", kept).withColumn("host_watched", yes(watched)).drop(name, rejected, watched)
