"""Derivations, leases, access rules and tracing, as set operations.

Work is planned for all candidate keys at once: what has succeeded, has failed
for good or is leased by someone alive is taken away by an anti join, and the
next attempt is one more than the largest so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors, identity

RUN_COLUMNS = ("run_id", "derivation_key", "status", "attempt", "worker_id", "started_at", "lease_expires_at", "lease_seconds")


# --- leases ------------------------------------------------------------------------------


def live(now_ms: int) -> Column:
    return (F.col("status") == "leased") & (F.col("lease_expires_at") > now_ms)


def claimable(candidates: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """The candidate keys that may be claimed, with the attempt that a claim would be."""
    state = runs.groupBy("derivation_key").agg(
        F.max(F.when(live(now_ms) | (F.col("status") == "succeeded") | ((F.col("status") == "failed") & F.coalesce("permanent", F.lit(False))), 1).otherwise(0)).alias("blocked"),
        F.max("attempt").alias("last"),
    )
    rows = candidates.dropDuplicates(["derivation_key"]).join(state, "derivation_key", "left")
    return rows.where("coalesce(blocked, 0) = 0").withColumn("attempt", F.coalesce(F.col("last"), F.lit(0)) + 1).drop("blocked", "last")


def reap(runs: DataFrame, now_ms: int) -> DataFrame:
    """Leases that have run out are abandoned; the store's clock alone counts."""
    out = (F.col("status") == "leased") & (F.col("lease_expires_at") <= now_ms)
    return runs.withColumn("status", F.when(out, "abandoned").otherwise(F.col("status")))


def claim(candidates: DataFrame, runs: DataFrame, versions: DataFrame, *, worker_id: str, lease_seconds: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(new runs, runs after): leases for all claimable candidates whose root version is there.

    ``candidates``: derivation_key, document_id, root_version_id. Whoever
    publishes the manifest with these rows holds the leases; a loser of that
    race starts again from the newer tables.
    """
    if lease_seconds <= 0:
        raise ValueError("a lease lasts at least a second")
    rows = claimable(candidates.join(versions.select(F.col("version_id").alias("root_version_id")), "root_version_id", "left_semi"), runs, now_ms)
    now = F.lit(now_ms).cast("bigint")
    run_id = identity.sha256(F.concat_ws(":", F.lit("run"), "derivation_key", F.col("attempt").cast("string")))
    new = rows.withColumns({
        "run_id": run_id, "status": F.lit("leased"), "worker_id": F.lit(worker_id), "started_at": now, "heartbeat_at": now, "lease_seconds": F.lit(lease_seconds),
        "lease_expires_at": now + lease_seconds * 1000, "permanent": F.lit(False),
    })
    touched = new.select("derivation_key").withColumn("claimed", F.lit(True))
    old = runs.join(touched, "derivation_key", "left")
    expired = F.col("claimed").isNotNull() & (F.col("status") == "leased")
    old = old.withColumn("status", F.when(expired, "abandoned").otherwise(F.col("status"))).drop("claimed")
    return new, old.unionByName(new, allowMissingColumns=True)


def lease_mismatch(worker: Column, key: Column, now_ms: int) -> Column:
    """Why a worker's claim on a run doesn't hold, the first reason that applies; null if it holds. A missing run has a null status."""
    return (
        F.when(F.col("status").isNull(), "run_missing").when(F.col("derivation_key") != key, "key_mismatch").when(F.col("status") != "leased", "not_leased")
        .when(F.col("lease_expires_at") <= now_ms, "lease_expired").when(F.col("worker_id") != worker, "other_worker")
    )


def check_leases(claims: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """``claims`` (run_id, claimed_by, claimed_key) with ``mismatch``."""
    known = runs.select("run_id", "derivation_key", "status", "lease_expires_at", "worker_id")
    return claims.join(known, "run_id", "left").withColumn("mismatch", lease_mismatch(F.col("claimed_by"), F.coalesce("claimed_key", "derivation_key"), now_ms)).select(*claims.columns, "mismatch")


def heartbeat(runs: DataFrame, run_id: str, worker_id: str, now_ms: int) -> DataFrame:
    """Extends a live lease of the worker by the seconds it was given; other runs stay."""
    mine = (F.col("run_id") == run_id) & (F.col("worker_id") == worker_id) & live(now_ms)
    ends = F.lit(now_ms).cast("bigint") + F.col("lease_seconds") * 1000
    return runs.withColumn("lease_expires_at", F.when(mine, ends).otherwise(F.col("lease_expires_at")))


def complete(runs: DataFrame, run_id: str, worker_id: str, status: str, now_ms: int, *, permanent: bool = False) -> DataFrame:
    if status not in ("succeeded", "failed"):
        raise ValueError("a run succeeds or fails")
    mine = (F.col("run_id") == run_id) & (F.col("worker_id") == worker_id) & live(now_ms)
    # at once: what is ended is a live lease no more
    return runs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "permanent": F.when(mine, F.lit(permanent and status == "failed")).otherwise(F.col("permanent"))})


def stale_worker_observations(claims: DataFrame, operation: str) -> DataFrame:
    """(kind, run_id, detail) of every refused claim."""
    bad = claims.where("mismatch IS NOT NULL")
    return bad.select(F.lit("stale_worker_rejected").alias("kind"), "run_id", F.to_json(F.struct(F.lit(operation).alias("operation"), F.col("claimed_by").alias("workerId"), "mismatch")).alias("detail"))


def run_failures(failed: DataFrame) -> DataFrame:
    """(kind, document_id, run_id, detail) of runs that ended in ``error``."""
    detail = F.struct(F.coalesce("error", F.lit("unknown")).alias("errorKind"), F.coalesce("permanent", F.lit(False)).alias("permanent"), "attempt")
    return failed.select(F.lit("run_failed").alias("kind"), "document_id", "run_id", F.to_json(detail).alias("detail"))


def divergence_observations(divergences: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, document_id, run_id, detail) of derivations that came out otherwise than what is stored; ``runs``: derivation_key, run_id."""
    old = stored.select("derivation_key", F.col("outputs_hash").alias("stored_hash"), F.col("artifact_count").alias("stored_count"))
    detail = F.struct(
        F.col("derivation_key").alias("derivationKey"), F.col("stored_hash").alias("storedOutputsHash"), F.col("stored_count").alias("storedArtifactCount"),
        F.col("outputs_hash").alias("incomingOutputsHash"), F.col("artifact_count").alias("incomingArtifactCount"),
    )
    rows = divergences.join(old, "derivation_key").join(runs.select("derivation_key", "run_id"), "derivation_key")
    return rows.select(F.lit("derivation_output_divergence").alias("kind"), "document_id", "run_id", F.to_json(detail).alias("detail"))


# --- commits -----------------------------------------------------------------------------


def draft_artifacts(drafts: DataFrame) -> DataFrame:
    """Drafts (derivation_key, document_id, root_version_id, ordinal, type, inline_content, blob_key, content_hash, size_bytes) as artifacts.

    Ids are derived, and so are the hash and size of inline contents.
    """
    inline = F.col("inline_content").isNotNull()
    return drafts.withColumns({
        "artifact_id": identity.artifact_id("derivation_key", "ordinal"),
        "content_hash": F.when(inline, identity.content_hash("inline_content")).otherwise(F.col("content_hash")),
        "size_bytes": F.when(inline, F.octet_length("inline_content").cast("bigint")).otherwise(F.col("size_bytes")),
    })


def outputs_of(artifacts: DataFrame) -> DataFrame:
    """derivation_key, artifact_count, outputs_hash, contiguous."""
    rows = artifacts.groupBy("derivation_key").agg(F.collect_list(F.struct("ordinal", "artifact_id", "content_hash")).alias("o"))
    return rows.select("derivation_key", F.size("o").cast("bigint").alias("artifact_count"), identity.outputs_hash("o").alias("outputs_hash"), identity.contiguous("o").alias("contiguous"))


def plan_commit(new: DataFrame, stored: DataFrame) -> DataFrame:
    """What committing derivations (derivation_key, artifact_count, outputs_hash) does: created, unchanged or divergent."""
    old = stored.select("derivation_key", F.col("artifact_count").alias("old_count"), F.col("outputs_hash").alias("old_hash"))
    same = (F.col("old_count") == F.col("artifact_count")) & (F.col("old_hash") == F.col("outputs_hash"))
    return new.join(old, "derivation_key", "left").withColumn("result", F.when(F.col("old_hash").isNull(), "created").when(same, "unchanged").otherwise("divergent")).drop("old_count", "old_hash")


def commit(derivations: DataFrame, drafts: DataFrame, stored_derivations: DataFrame, stored_artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(derivations after, artifacts after, divergences) of ``commit_rows``."""
    heads, artifacts, divergent = commit_rows(derivations, drafts, stored_derivations)
    return stored_derivations.unionByName(heads, allowMissingColumns=True), stored_artifacts.unionByName(artifacts, allowMissingColumns=True), divergent


def commit_rows(derivations: DataFrame, drafts: DataFrame, stored_derivations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new derivations, new artifacts, divergences). All or nothing a key: a divergent key adds no row.

    ``derivations``: derivation_key, document_id, root_version_id and whatever
    else the stored table has beside counts and hashes.
    """
    artifacts = draft_artifacts(drafts)
    outputs = outputs_of(artifacts)
    plan = plan_commit(derivations.join(outputs, "derivation_key", "left").withColumns({"artifact_count": F.coalesce("artifact_count", F.lit(0)), "outputs_hash": F.coalesce("outputs_hash", identity.sha256(F.lit("out:")))}), stored_derivations)
    broken = plan.where("contiguous = false").limit(1).collect()
    if broken:
        raise ValueError(f"ordinals of {broken[0]['derivation_key']} aren't 0 .. n - 1")
    created = plan.where("result = 'created'")
    rows = created.select("derivation_key")
    return (
        created.drop("result", "contiguous"),
        artifacts.join(rows, "derivation_key", "left_semi"),
        plan.where("result = 'divergent'").select("derivation_key", "document_id", "outputs_hash", "artifact_count"),
    )


def assert_no_divergence(divergences: DataFrame) -> None:
    bad = divergences.limit(1).collect()
    if bad:
        raise errors.DerivationDivergenceError(f"another output under {bad[0]['derivation_key']}")


# --- access rules ------------------------------------------------------------------------


def upsert_acl(stored: DataFrame, drafts: DataFrame, now_ms: int) -> DataFrame:
    """The access rules after the drafts, one a (document, tenant).

    What is unknown never takes the place of what was synced: then only the
    attempt and the error are noted. Principals are stored in order.
    """
    bad = drafts.where("state = 'unknown' AND size(principals) > 0").limit(1).collect()
    if bad:
        raise ValueError("unknown access with principals")
    key, now = ["document_id", "tenant_id"], F.lit(now_ms).cast("bigint")
    new = drafts.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("state", "principals", "classification", "acl_hash", "last_error")], F.lit(True).alias("drafted"))
    j = stored.join(new, key, "full_outer")
    drafted = F.col("drafted").isNotNull()
    keep = ~drafted | ((F.col("n_state") == "unknown") & F.coalesce(F.col("state") == "synced", F.lit(False)))
    put = lambda c, fresh: F.when(keep, F.col(c)).otherwise(fresh).alias(c)
    return j.select(
        *key, put("state", F.col("n_state")), put("principals", F.array_sort("n_principals")), put("classification", F.col("n_classification")), put("acl_hash", F.col("n_acl_hash")),
        put("synced_at", F.when(F.col("n_state") == "synced", now)), F.when(drafted, now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
        F.when(drafted, F.col("n_last_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def acl_observations(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """(kind, document_id, detail) of every draft against the rules before it: changed, not fetched, or not fetched with the synced ones kept."""
    had = stored.select("document_id", "tenant_id", F.col("state").alias("had"))
    j = drafts.join(had, ["document_id", "tenant_id"], "left")
    kept = (F.col("state") == "unknown") & F.coalesce(F.col("had") == "synced", F.lit(False))
    tenant = F.col("tenant_id").alias("tenantId")
    told = F.to_json(F.struct(tenant, F.lit(True).alias("keptExistingSynced"), F.col("last_error").alias("error")), {"ignoreNullFields": "false"})
    return j.select(
        F.when(F.col("state") == "synced", "acl_changed").otherwise("acl_fetch_failed").alias("kind"), "document_id",
        F.when(kept, told).otherwise(F.to_json(F.struct(tenant, "state"))).alias("detail"),
    )


# --- reading back ------------------------------------------------------------------------


def trace_to_origin(artifacts: DataFrame, derivations: DataFrame, versions: DataFrame, documents: DataFrame, *, strict: bool = False) -> DataFrame:
    """Each artifact with its derivation, version and document, and ``broken``: the first link that isn't there."""
    d = derivations.select("derivation_key", "processor_name", "processor_version")
    v = versions.select(F.col("version_id").alias("root_version_id"), F.col("document_id").alias("version_document_id"))
    doc = documents.select(F.col("document_id").alias("version_document_id"), "source_id", "stable_key")
    out = artifacts.select("artifact_id", "derivation_key", "root_version_id").join(d, "derivation_key", "left").join(v, "root_version_id", "left").join(doc, "version_document_id", "left")
    broken = F.when(F.col("processor_name").isNull(), "derivation").when(F.col("version_document_id").isNull(), "version").when(F.col("stable_key").isNull(), "document")
    if strict:
        broken = F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("broken lineage of "), "artifact_id")))
    return out.select("artifact_id", "derivation_key", "root_version_id", F.col("version_document_id").alias("document_id"), "source_id", "stable_key", broken.alias("broken"))


def blob_references(versions: DataFrame, artifacts: DataFrame, *, after: str = "", limit: int | None = None) -> DataFrame:
    """(cursor, kind, ref_id, blob_key, content_hash) of every stored blob that is referred to, after a cursor, a page at a time."""
    a = artifacts.where("blob_key IS NOT NULL").select(F.lit("artifact").alias("kind"), F.col("artifact_id").alias("ref_id"), "blob_key", "content_hash")
    v = versions.select(F.lit("version").alias("kind"), F.col("version_id").alias("ref_id"), "blob_key", "content_hash")
    rows = a.unionByName(v).withColumn("cursor", F.concat_ws(":", "kind", "ref_id")).where(F.col("cursor") > after)
    rows = rows.select("cursor", "kind", "ref_id", "blob_key", "content_hash")
    return rows if limit is None else rows.orderBy("cursor").limit(limit)


class BlobCursor:
    """Pages through the references, and begins again when they are through."""

    def __init__(self) -> None:
        self.at = ""

    def page(self, versions: DataFrame, artifacts: DataFrame, limit: int) -> list:
        got = blob_references(versions, artifacts, after=self.at, limit=limit).collect()
        self.at = got[-1]["cursor"] if len(got) == limit else ""
        return got


def rename_candidates(disappeared: DataFrame, appeared: DataFrame) -> DataFrame:
    """Pairs of a document that went and one that came with the same content (document_id, content_hash); recorded, never acted on."""
    a = disappeared.select(F.col("document_id").alias("disappeared_document_id"), "content_hash")
    b = appeared.select(F.col("document_id").alias("appeared_document_id"), "content_hash")
    return a.join(b, "content_hash").where("disappeared_document_id <> appeared_document_id").withColumn("resolution", F.lit("unresolved"))


def artifact_evidence(t: Mapping[str, DataFrame], kind: str, most_bytes: int) -> DataFrame:
    """Every artifact of a kind of one input and one output, with ``problem``: the first thing that doesn't add up; null if all does.

    Its key and id are derived again from the stored materials, and its
    content, counts, root, outputs and a run that succeeded must agree with them.
    """
    a = t["artifact"].where(F.col("type") == kind).withColumn("actual", identity.content_hash("inline_content"))
    d = t["derivation"].select(
        "derivation_key", "processor_name", "processor_version", "config_hash", F.from_json("input_ids", "array<string>").alias("inputs"), F.col("root_version_id").alias("d_root"), F.col("document_id").alias("d_document"),
        "artifact_count", "outputs_hash", F.lit(True).alias("derived"),
    )
    stored = t["artifact"].join(a.select("derivation_key").distinct(), "derivation_key", "left_semi").groupBy("derivation_key").agg(F.count(F.lit(1)).alias("stored"))
    roots = t["document_version"].select(F.col("version_id").alias("d_root"), F.col("document_id").alias("owner"))
    won = t["processing_run"].where("status = 'succeeded'").select("derivation_key", F.col("root_version_id").alias("d_root"), F.col("document_id").alias("d_document"), F.lit(True).alias("won")).distinct()
    j = a.join(d, "derivation_key", "left").join(stored, "derivation_key").join(roots, "d_root", "left").join(won, ["derivation_key", "d_root", "d_document"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    only = F.size("inputs") == 1
    key = identity.derivation_key("processor_name", "processor_version", "config_hash", F.slice("inputs", 1, 1))
    ident = identity.artifact_id("derivation_key", F.lit(0))
    problem = (
        F.when(F.col("inline_content").isNull() | F.col("blob_key").isNotNull(), "form").when(F.octet_length("inline_content") > most_bytes, "limit").when(F.col("derived").isNull(), "derivation")
        .when(no(only & F.col("inputs")[0].isNotNull()), "input").when(no(key == F.col("derivation_key")), "key").when(no((ident == F.col("artifact_id")) & (F.col("ordinal") == 0)), "id")
        .when(no((F.col("artifact_count") == 1) & (F.col("stored") == 1)), "count")
        .when(no((F.col("owner") == F.col("d_document")) & (F.col("root_version_id") == F.col("d_root")) & (F.col("document_id") == F.col("d_document"))), "root")
        .when(no((F.col("content_hash") == F.col("actual")) & (F.col("size_bytes") == F.octet_length("inline_content"))), "content").when(F.col("won").isNull(), "run")
        .when(no(F.col("outputs_hash") == identity.sha256(F.concat(F.lit("out:"), "artifact_id", F.lit(":"), "actual"))), "outputs")
    )
    return j.select("artifact_id", "derivation_key", "root_version_id", "document_id", "created_at", "inline_content", F.col("inputs")[0].alias("input_id"), problem.alias("problem"))


def derivation_status(rows: DataFrame, derivations: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with ``status`` of their derivation_key: unsupported (it is null), ready, waiting for a lease, failed, or not_parsed.

    ``broken``: a run says it succeeded, and there is no result.
    """
    have = derivations.select("derivation_key", F.lit(True).alias("derived"))
    tried = runs.groupBy("derivation_key").agg(F.max(F.struct("attempt", "run_id", "status"))["status"].alias("latest"), F.max((F.col("status") == "succeeded").cast("int")).alias("won"))
    status = (
        F.when(F.col("derivation_key").isNull(), "unsupported").when(F.col("derived"), "ready").when(F.col("won") == 1, "broken").when(F.col("latest") == "leased", "waiting")
        .when(F.col("latest").isNotNull(), "failed").otherwise("not_parsed")
    )
    return rows.join(have, "derivation_key", "left").join(tried, "derivation_key", "left").select(*rows.columns, status.alias("status"))


def known_processors(derivations: DataFrame) -> Iterable:
    return derivations.groupBy("processor_name", "processor_version", "config_hash").agg(F.count(F.lit(1)).alias("derivations"), F.sum("artifact_count").alias("artifacts"))
