"""The observation log and the entries of sources as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import OBSERVATION_SCHEMA


def observation_stream(spark: SparkSession, path: str) -> DataFrame:
    """Observations as they are appended to a folder of Parquet files."""
    return spark.readStream.schema(OBSERVATION_SCHEMA).parquet(path)


def kind_counts(observations: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Observations by kind and window of their time; rows later than the watermark are left out."""
    timed = observations.withColumn("at", F.timestamp_millis("occurred_at"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n"))


def latest_pointers(observations: DataFrame) -> DataFrame:
    """Per document the version of its last created or reverted observation, kept up to date."""
    told = observations.where("kind IN ('version_created', 'version_reverted') AND version_id IS NOT NULL")
    return told.groupBy("document_id").agg(F.max_by("version_id", "observation_seq").alias("version_id"), F.max("observation_seq").alias("observation_seq"))


def scan_each_batch(entries: DataFrame, scan: Callable[[DataFrame, int], Any], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of entries is one scan; a batch that runs again has the same number, so ``scan`` can tell."""
    return entries.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_OUT = "derivation_key string, status string, attempt bigint"
_STATE = "status string, attempt bigint, expires bigint"


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """One key's lease: events move it, and the timer abandons it when it runs out."""
    if state.hasTimedOut:
        status, attempt, _ = state.get
        state.remove()
        yield pd.DataFrame({"derivation_key": [key[0]], "status": ["abandoned" if status == "leased" else status], "attempt": [attempt]})
        return
    status, attempt, expires = state.get if state.exists else ("", 0, 0)
    for batch in batches:
        for r in batch.sort_values("observation_seq").itertuples():
            if r.event == "claim" and status not in ("leased", "succeeded"):
                status, attempt, expires = "leased", attempt + 1, r.expires_at
            elif r.event == "heartbeat" and status == "leased":
                expires = max(expires, r.expires_at)
            elif r.event in ("succeeded", "failed") and status == "leased":
                status = r.event
    state.update((status, attempt, int(expires)))
    if status == "leased":
        state.setTimeoutTimestamp(max(int(expires), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"derivation_key": [key[0]], "status": [status], "attempt": [attempt]})


def lease_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Leases by key from a stream (derivation_key, event, observation_seq, expires_at, at); time is the events' own."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.withWatermark("at", late).groupBy("derivation_key").applyInPandasWithState(_lease, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
