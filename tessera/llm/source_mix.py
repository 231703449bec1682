"""Mixing sources to target weights by Poisson replication.

A document of a source with the target repetition rate r is repeated k times,
k drawn from a Poisson distribution of mean r by inverting it at a uniform
number that a hash of the seed and the document's id gives. Expected shares of
the sources are then the target weights; nothing is drawn twice differently, on
whatever machine. Copies are shuffled globally by a hash of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name
from .components import bounded

#: Without given weights a source's weight is its number of documents to this power.
TEMPERATURE = 0.7
#: A draw of a larger mean is the sum of several independent draws of at most this mean, which is the same distribution.
LARGEST_MEAN = 16.0
#: Probability left above the end of an inversion table of a mean of 16 is below 1e-20.
TABLE = 80
#: Rate tables of at most this many sources are broadcast.
BROADCAST_SOURCES = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the seed and the parts, colon-joined; nulls are empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _table(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0 .. TABLE - 1."""
    begin = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), begin, step)["all"]


def source_rates(docs: DataFrame, *, source: str = "source", weights: Mapping[str, float] | None = None, size: float | None = None) -> DataFrame:
    """One row a source: source, n, rate, draws, cumulated.

    ``size`` is the expected number of rows of the mix (by default as many as
    ``docs`` has). ``weights`` gives each source's share, up to a factor;
    sources it doesn't name get none. By default shares follow the number of
    documents to the power ``TEMPERATURE``. A null source is a source of its own.
    """
    counts = checkpoint(docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in sorted(weights.items(), key=str)], F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("w", weight)
    n, total = counts.agg(F.sum("n"), F.sum("w")).first()  # two numbers
    goal = float(size if size is not None else n or 0)
    rate = F.lit(0.0) if not total else goal * (F.col("w") / F.lit(total)) / F.col("n")
    out = counts.withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    return checkpoint(out.withColumn("cumulated", _table(F.col("rate") / F.col("draws"))).select("source", "n", "rate", "draws", "cumulated"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, size: float | None = None, seed: int = 7) -> DataFrame:
    """``docs`` replicated: all columns, ``replica`` (from 0) and ``shuffle_key``, in a global random order.

    A document drawn zero times has no row: that is the mix, not a sample for
    speed. Rows of one id are drawn alike. Rows are dealt to partitions by their
    random key and ordered by it within them, so the files one after another are
    a uniform shuffle; a hot source spreads evenly. Texts cross the network once.
    """
    rates = source_rates(docs, source=source, weights=weights, size=size)
    key, draws, table, times, chance = (free_name(docs, x) for x in ("mix_source", "mix_draws", "mix_table", "mix_times", "mix_uniform"))
    rates = rates.select(F.col("source").alias(key), F.col("draws").alias(draws), F.col("cumulated").alias(table))
    joined = docs.join(bounded(rates, rates.count(), BROADCAST_SOURCES), F.col(f"`{source}`").eqNullSafe(F.col(key)))
    ident = F.col(f"`{doc_id}`")
    one = lambda j: F.size(F.filter(F.col(table), lambda c: c < uniform(seed, ident, j)))
    single = F.size(F.filter(F.col(table), lambda c: c < F.col(chance)))
    drawn = joined.withColumn(chance, uniform(seed, ident, F.lit(1))).withColumn(
        times,
        F.when(F.col(draws) == 1, single).otherwise(F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda acc, j: acc + one(j))),
    )
    copies = drawn.where(F.col(times) > 0).withColumn("replica", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(ident.cast("string"), F.lit("")), F.col("replica").cast("string")).cast("binary")))
    return copies.drop(key, draws, table, times, chance).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
