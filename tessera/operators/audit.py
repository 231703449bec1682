"""The audit: integrity rules over the lineage tables.

Every rule maps tables to findings (subject, detail). Rules are set operations
that Catalyst plans as semi, anti and equi joins; none reads artifact contents
unless it hashes them. The formulas of identities are written out here again on
purpose: an audit that shared the writers' code would repeat their mistakes.

Fifteen invariants group the rules, and five guards check the tables'
structure. A result is ``ok``, ``violated`` or ``not_checked``; what wasn't
looked at never counts as fine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key

Tables = Mapping[str, DataFrame]
Rule = Callable[[Tables], DataFrame]


def _found(df: DataFrame, subject: Column | str, detail: Column | str | None = None) -> DataFrame:
    s = F.col(subject) if isinstance(subject, str) else subject
    d = F.lit("") if detail is None else F.col(detail) if isinstance(detail, str) else detail
    return df.select(s.cast("string").alias("subject"), F.coalesce(d.cast("string"), F.lit("")).alias("detail"))


def _orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, subject: str, keep_null: bool = True) -> DataFrame:
    """Rows whose reference has no target. A null reference has none either, unless told otherwise."""
    rows = child if keep_null else child.where(F.col(key).isNotNull())
    return _found(rows.join(parent.select(F.col(parent_key).alias("__ref")).distinct(), F.col(key) == F.col("__ref"), "left_anti"), subject, key)


# --- rules -------------------------------------------------------------------------------


def artifact_root_version_missing(t: Tables) -> DataFrame:
    return _orphans(t["artifact"], "root_version_id", t["document_version"], "version_id", "artifact_id")


def artifact_document_missing(t: Tables) -> DataFrame:
    return _orphans(t["artifact"], "document_id", t["document"], "document_id", "artifact_id")


def artifact_document_disagrees_with_version(t: Tables) -> DataFrame:
    v = t["document_version"].select(F.col("version_id").alias("root_version_id"), F.col("document_id").alias("owner"))
    return _found(t["artifact"].join(v, "root_version_id").where("owner <> document_id"), "artifact_id", "owner")


def artifact_disagrees_with_derivation(t: Tables) -> DataFrame:
    d = t["derivation"].select("derivation_key", F.col("document_id").alias("d_doc"), F.col("root_version_id").alias("d_root"))
    return _found(t["artifact"].join(d, "derivation_key").where("d_doc <> document_id OR d_root <> root_version_id"), "artifact_id", "derivation_key")


def derivation_root_version_missing(t: Tables) -> DataFrame:
    return _orphans(t["derivation"], "root_version_id", t["document_version"], "version_id", "derivation_key")


def version_document_missing(t: Tables) -> DataFrame:
    return _orphans(t["document_version"], "document_id", t["document"], "document_id", "version_id")


def broken_blob_reference_not_quarantined(t: Tables) -> DataFrame:
    broken = t["observation"].where("kind = 'blob_reference_broken'").select("document_id")
    return _found(broken.join(t["document"].where("state <> 'quarantined'").select("document_id", "state"), "document_id"), "document_id", "state")


def artifact_without_derivation(t: Tables) -> DataFrame:
    return _orphans(t["artifact"], "derivation_key", t["derivation"], "derivation_key", "artifact_id")


def artifact_count_mismatch(t: Tables) -> DataFrame:
    n = t["artifact"].groupBy("derivation_key").agg(F.count(F.lit(1)).alias("n"))
    rows = t["derivation"].select("derivation_key", "artifact_count").join(n, "derivation_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _found(rows.where("artifact_count <> n"), "derivation_key", "n")


def active_version_missing(t: Tables) -> DataFrame:
    return _orphans(t["document"], "active_version_id", t["document_version"], "version_id", "document_id", keep_null=False)


def active_version_belongs_to_other_document(t: Tables) -> DataFrame:
    v = t["document_version"].select(F.col("version_id").alias("active_version_id"), F.col("document_id").alias("owner"))
    return _found(t["document"].join(v, "active_version_id").where("owner <> document_id"), "document_id", "owner")


def stable_key_collides_after_normalization(t: Tables) -> DataFrame:
    """Documents of a source whose keys are one after normalisation; the first in order of the stored key is the one collided with."""
    policy = t["source"].select("source_id", "key_unicode_form", "key_case_fold", "key_path_separator", "key_trim_slashes")
    norm = normalize_key("stable_key", "key_unicode_form", "key_case_fold", "key_path_separator", "key_trim_slashes")
    rows = t["document"].select("document_id", "source_id", "stable_key").join(policy, "source_id").withColumn("norm", norm)
    rows = rows.select("document_id", "source_id", "stable_key", "norm")
    first = rows.groupBy("source_id", "norm").agg(F.min(F.struct("stable_key", "document_id")).alias("f")).select("source_id", "norm", F.col("f.document_id").alias("first"))
    return _found(rows.join(first, ["source_id", "norm"]).where("first <> document_id"), "document_id", "first")


def active_document_in_orphaned_source(t: Tables, known: Iterable[str] = ()) -> DataFrame:
    """Active documents of sources outside ``known``; with none known, all active documents."""
    rows, names = t["document"].where("state = 'active'"), list(known)
    return _found(rows.where(~F.col("source_id").isin(names)) if names else rows, "document_id", "source_id")


def _tombstones(t: Tables) -> DataFrame:
    return t["observation"].where("kind = 'document_tombstoned'").select("document_id", "scan_id", "occurred_at")


def tombstone_written_by_aborted_scan(t: Tables) -> DataFrame:
    s = t["scan_run"].where("status = 'aborted_safety'").select("scan_id", "abort_reason")
    return _found(_tombstones(t).join(s, "scan_id"), "document_id", "scan_id")


def aborted_scan_without_observation(t: Tables) -> DataFrame:
    told = t["observation"].where("kind = 'scan_aborted_safety'").select("scan_id").distinct()
    return _found(t["scan_run"].where("status = 'aborted_safety'").join(told, "scan_id", "left_anti"), "scan_id", "source_id")


def tombstone_from_non_promoted_scan(t: Tables) -> DataFrame:
    s = t["scan_run"].where("status <> 'completed' OR write_failure_count <> 0").select("scan_id", "status")
    return _found(_tombstones(t).join(s, "scan_id"), "document_id", F.concat_ws(":", "scan_id", "status"))


def tombstone_without_scan(t: Tables) -> DataFrame:
    return _found(_tombstones(t).where("scan_id IS NULL"), "document_id")


def _superseding(t: Tables) -> DataFrame:
    """(scan_id, next_end) of every scan: when the first of the completed scans of its source with a larger completion_seq finished.

    A running minimum over a source's scans, which are control rows; tombstones then meet one row by scan_id, however hot their source.
    """
    after = Window.partitionBy("source_id").orderBy("completion_seq").rangeBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(F.col("status") == "completed", F.col("finished_at"))).over(after)
    return t["scan_run"].where("completion_seq IS NOT NULL").select("scan_id", end.alias("next_end"))


def tombstone_from_superseded_scan(t: Tables) -> DataFrame:
    return _found(_tombstones(t).join(_superseding(t), "scan_id").where("next_end < occurred_at"), "document_id", "scan_id")


def tombstoned_without_observation(t: Tables) -> DataFrame:
    return _found(t["document"].where("state = 'tombstoned'").join(_tombstones(t).select("document_id").distinct(), "document_id", "left_anti"), "document_id")


def completion_tombstone_order_unknown(t: Tables) -> DataFrame:
    """Tombstones written in the very millisecond in which a later scan of the source finished: the scan is met by (source, time)."""
    scans = t["scan_run"].select("scan_id", "source_id", "completion_seq")
    done = t["scan_run"].where("status = 'completed'").groupBy("source_id", F.col("finished_at").alias("occurred_at")).agg(F.max("completion_seq").alias("latest"))
    return _found(_tombstones(t).join(scans, "scan_id").join(done, ["source_id", "occurred_at"]).where("latest > completion_seq"), "document_id", "scan_id")


def blob_verified_at_missing(t: Tables) -> DataFrame:
    return _found(t["document_version"].where("blob_verified_at IS NULL OR blob_verified_at <= 0"), "version_id")


def blob_key_missing(t: Tables) -> DataFrame:
    return _found(t["document_version"].where("blob_key IS NULL OR blob_key = ''"), "version_id")


def blob_verified_after_ingest(t: Tables) -> DataFrame:
    return _found(t["document_version"].where("blob_verified_at > ingested_at"), "version_id")


def artifact_ordinals_not_contiguous(t: Tables) -> DataFrame:
    rows = t["artifact"].select("derivation_key", "ordinal").join(t["derivation"].select("derivation_key"), "derivation_key", "left_semi")
    g = rows.groupBy("derivation_key").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count(F.lit(1)).alias("n"))
    return _found(g.where("lo <> 0 OR hi <> n - 1"), "derivation_key", F.concat_ws(":", F.col("lo").cast("string"), F.col("hi").cast("string"), F.col("n").cast("string")))


def divergence_observed(t: Tables) -> DataFrame:
    return _found(t["observation"].where("kind = 'derivation_output_divergence'"), F.coalesce("document_id", "observation_id"))


def outputs_hash_does_not_match_artifacts(t: Tables) -> DataFrame:
    """The stored hash against one recomputed from the artifacts' ids and hashes in order; a derivation without artifacts hashes none."""
    pair = F.struct("ordinal", F.concat("artifact_id", F.lit(":"), "content_hash").alias("p"))
    rows = t["artifact"].select("derivation_key", pair.alias("x")).groupBy("derivation_key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = F.coalesce(F.array_join(F.transform("xs", lambda x: x["p"]), "\0"), F.lit(""))
    both = t["derivation"].select("derivation_key", "outputs_hash").join(rows, "derivation_key", "left").withColumn("want", F.sha2(F.concat(F.lit("out:"), joined).cast("binary"), 256))
    return _found(both.where("want <> outputs_hash"), "derivation_key", "want")


def active_pointer_does_not_match_latest_observation(t: Tables) -> DataFrame:
    """The pointer against the version of the last created or reverted observation; a null pointer matches none."""
    told = t["observation"].where("kind IN ('version_created', 'version_reverted') AND version_id IS NOT NULL AND document_id IS NOT NULL")
    last = told.groupBy("document_id").agg(F.max_by("version_id", "observation_seq").alias("latest"))
    return _found(t["document"].select("document_id", "active_version_id").join(last, "document_id").where("NOT (active_version_id <=> latest)"), "document_id", "latest")


def versions_exist_but_no_active_pointer(t: Tables) -> DataFrame:
    rows = t["document"].where("active_version_id IS NULL AND state = 'active'")
    return _found(rows.join(t["document_version"].select("document_id").distinct(), "document_id", "left_semi"), "document_id")


def duplicate_content_hash_for_document(t: Tables) -> DataFrame:
    return _found(t["document_version"].groupBy("document_id", "content_hash").count().where("count > 1"), "document_id", "content_hash")


def failed_acl_fetch_recorded_as_synced(t: Tables) -> DataFrame:
    rows = t["access_control"].where("state = 'synced' AND last_error IS NOT NULL")
    empty = F.size("principals") == 0 if dict(rows.dtypes)["principals"].startswith("array") else F.col("principals") == "[]"
    return _found(rows.where(empty), "document_id", "tenant_id")


def multiple_running_scans_for_source(t: Tables) -> DataFrame:
    return _found(t["scan_run"].where("status = 'running'").groupBy("source_id").count().where("count > 1"), "source_id", "count")


def artifact_inline_hash_mismatch(t: Tables) -> DataFrame:
    rows = t["artifact"].where("inline_content IS NOT NULL").withColumn("actual", F.sha2(F.col("inline_content").cast("binary"), 256))
    return _found(rows.where("actual <> content_hash"), "artifact_id", "actual")


def artifact_inline_size_mismatch(t: Tables) -> DataFrame:
    rows = t["artifact"].where("inline_content IS NOT NULL").withColumn("actual", F.octet_length("inline_content").cast("bigint"))
    return _found(rows.where("actual <> size_bytes"), "artifact_id", "actual")


def _blob_findings(t: Tables, table: str, subject: str) -> DataFrame:
    """References against the hashes of the stored bytes; a blob that isn't there doesn't match."""
    refs = t[table].where("blob_key IS NOT NULL").select(subject, "blob_key", "content_hash")
    have = t["blob"].select("blob_key", F.sha2("content", 256).alias("actual"))
    return _found(refs.join(have, "blob_key", "left").where("NOT (actual <=> content_hash)"), subject, "blob_key")


def version_blob_hash_mismatch(t: Tables) -> DataFrame:
    return _blob_findings(t, "document_version", "version_id")


def artifact_blob_hash_mismatch(t: Tables) -> DataFrame:
    return _blob_findings(t, "artifact", "artifact_id")


def _materials(t: Tables) -> DataFrame:
    rows = t["derivation"].select("derivation_key", "processor_name", "processor_version", "config_hash", "input_ids")
    # a variant tells a string from a number, which from_json would turn into one
    v = F.try_parse_json("input_ids")
    ids = F.from_json("input_ids", "array<string>")
    rows = rows.withColumn("is_json", v.isNotNull()).withColumn("shape", F.schema_of_variant(v)).withColumn("ids", ids)
    return rows.withColumn("strings", F.col("shape").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists("ids", lambda x: x.isNull()))


def input_ids_not_json(t: Tables) -> DataFrame:
    return _found(_materials(t).where("NOT is_json"), "derivation_key")


def input_ids_not_a_string_array(t: Tables) -> DataFrame:
    return _found(_materials(t).where("is_json AND NOT coalesce(strings, false)"), "derivation_key")


def input_ids_not_stored_in_key_order(t: Tables) -> DataFrame:
    return _found(_materials(t).where("is_json AND strings").where(F.array_sort("ids") != F.col("ids")), "derivation_key")


def derivation_key_does_not_match_materials(t: Tables) -> DataFrame:
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    ids = F.concat(F.size("ids").cast("string"), F.lit(":"), F.array_join(F.transform(F.array_sort("ids"), part), ""))
    want = F.sha2(F.concat(F.lit("der:"), *[part(F.col(c)) for c in ("processor_name", "processor_version", "config_hash")], ids).cast("binary"), 256)
    return _found(_materials(t).where("is_json AND strings").withColumn("want", want).where("want <> derivation_key"), "derivation_key", "want")


def multiple_leased_runs_for_key(t: Tables) -> DataFrame:
    return _found(t["processing_run"].where("status = 'leased'").groupBy("derivation_key").count().where("count > 1"), "derivation_key", "count")


INVARIANTS: dict[str, tuple[Rule, ...]] = {
    "LINEAGE_COMPLETE": (
        artifact_root_version_missing, artifact_document_missing, artifact_document_disagrees_with_version, artifact_disagrees_with_derivation,
        derivation_root_version_missing, version_document_missing, broken_blob_reference_not_quarantined,
    ),
    "NO_ORPHAN_ARTIFACT": (artifact_without_derivation, artifact_count_mismatch),
    "SINGLE_ACTIVE_VERSION": (active_version_missing, active_version_belongs_to_other_document, stable_key_collides_after_normalization),
    "SAFETY_ABORT_WRITES_NOTHING": (tombstone_written_by_aborted_scan, aborted_scan_without_observation),
    "DELETION_ONLY_FROM_COMPLETED_SCAN": (
        tombstone_from_non_promoted_scan, tombstone_without_scan, tombstone_from_superseded_scan, tombstoned_without_observation,
    ),
    "NO_VERSION_WITHOUT_VERIFIED_BLOB": (blob_verified_at_missing, blob_key_missing, blob_verified_after_ingest),
    "DERIVATION_OUTPUT_STABLE": (artifact_ordinals_not_contiguous, divergence_observed, outputs_hash_does_not_match_artifacts),
    "POINTER_MATCHES_OBSERVATION": (active_pointer_does_not_match_latest_observation, versions_exist_but_no_active_pointer),
    "ACL_DOES_NOT_VERSION": (duplicate_content_hash_for_document, failed_acl_fetch_recorded_as_synced),
    "ONE_RUNNING_SCAN_PER_SOURCE": (multiple_running_scans_for_source,),
    "HASH_MATCHES_BLOB": (artifact_inline_hash_mismatch, artifact_inline_size_mismatch),
    "DERIVATION_KEY_MATCHES_MATERIALS": (
        input_ids_not_json, input_ids_not_a_string_array, input_ids_not_stored_in_key_order, derivation_key_does_not_match_materials,
    ),
    "IDEMPOTENT_REPLAY": (),
    "NO_WORK_WITHOUT_CHANGE": (),
    "CANONICAL_KEY_STABILITY": (),
}

#: What the tables' structure must hold, since Spark has no constraints of its own: unique keys by table.
UNIQUE_KEYS = {
    "document": ("source_id", "stable_key"), "document_version": ("document_id", "content_hash"), "artifact": ("derivation_key", "ordinal"), "observation": ("observation_id",),
}
GUARDS = (
    "REQUIRED_PARTIAL_UNIQUE_INDEXES", "REQUIRED_UNIQUE_CONSTRAINTS", "OBSERVATION_TOTAL_ORDER", "DOCUMENT_VERSION_IMMUTABLE_TRIGGER", "ONE_LEASED_RUN_PER_KEY",
)


@dataclass
class Result:
    """``findings`` are the first of each rule, with the exact number of all; ``rows`` are all of them, by rule, as DataFrames."""

    name: str
    status: str
    findings: list[dict] = field(default_factory=list)
    reason: str = ""
    rows: dict[str, DataFrame] = field(default_factory=dict)


#: Findings that a report prints of each rule; counts are exact, and ``Result.rows`` holds all.
SHOWN = 100


def _result(name: str, rules: Iterable[tuple[str, Callable[[], DataFrame]]]) -> Result:
    out: list[dict] = []
    every: dict[str, DataFrame] = {}
    for problem, rule in rules:
        rows = rule()
        n = rows.count()
        if n:
            every[problem] = rows
        shown = rows.orderBy("subject", "detail").limit(SHOWN).collect() if n else []
        out += [{"problem": problem, "subject": r["subject"], "detail": r["detail"], "of": n} for r in shown]
    return Result(name, "violated" if out else "ok", out, rows=every)


def all_findings(results: Iterable[Result]) -> DataFrame | None:
    """(invariant, problem, subject, detail) of every finding of every rule, none left out; None if there are none."""
    out = None
    for r in results:
        for problem, rows in r.rows.items():
            rows = rows.select(F.lit(r.name).alias("invariant"), F.lit(problem).alias("problem"), "subject", "detail")
            out = rows if out is None else out.unionByName(rows)
    return out


def _guarded(name: str, make: Callable[[], Result]) -> Result:
    """A check that breaks is not checked; the others go on."""
    try:
        return make()
    except Exception as error:  # noqa: BLE001  any failure of one check means the same
        return Result(name, "not_checked", reason=f"{type(error).__name__}: {str(error).splitlines()[0][:300]}")


def duplicates(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    keys = list(keys)
    rows = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).count().where("count > 1")
    return _found(rows, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "count")


def check_guards(t: Tables) -> list[Result]:
    running = lambda: t["scan_run"].where("status = 'running'")
    leased = lambda: t["processing_run"].where("status = 'leased'")
    done = lambda: t["scan_run"].where("completion_seq IS NOT NULL")
    partial = [
        ("one_running_scan", lambda: duplicates(running(), ["source_id"])), ("one_leased_run", lambda: duplicates(leased(), ["derivation_key"])),
        ("scan_completion_seq", lambda: duplicates(done(), ["source_id", "completion_seq"])),
    ]
    unique = [(f"{name}({', '.join(keys)})", lambda n=name, k=keys: duplicates(t[n], k)) for name, keys in UNIQUE_KEYS.items()]

    def ordered() -> Result:
        kinds = dict(t["observation"].dtypes)
        if "observation_seq" not in kinds:
            return Result("OBSERVATION_TOTAL_ORDER", "violated", [{"problem": "missing_total_order_column", "subject": "observation.observation_seq", "detail": "", "of": 1}])
        if kinds["observation_seq"] not in ("bigint", "int"):
            return Result("OBSERVATION_TOTAL_ORDER", "violated", [{"problem": "total_order_column_is_not_integer", "subject": "observation.observation_seq", "detail": kinds["observation_seq"], "of": 1}])
        return _result("OBSERVATION_TOTAL_ORDER", [("total_order_column_is_not_primary_key", lambda: duplicates(t["observation"], ["observation_seq"]))])

    def immutable() -> Result:
        """A version row never changes: no version id may stand for two contents."""
        rows = lambda: t["document_version"].groupBy("version_id").agg(F.countDistinct("document_id", "content_hash", "size_bytes").alias("n")).where("n > 1")
        return _result("DOCUMENT_VERSION_IMMUTABLE_TRIGGER", [("version_rewritten", lambda: _found(rows(), "version_id", "n"))])

    return [
        _guarded(GUARDS[0], lambda: _result(GUARDS[0], partial)), _guarded(GUARDS[1], lambda: _result(GUARDS[1], unique)), _guarded(GUARDS[2], ordered),
        _guarded(GUARDS[3], immutable), _guarded(GUARDS[4], lambda: _result(GUARDS[4], [("multiple_leased_runs_for_key", lambda: multiple_leased_runs_for_key(t))])),
    ]


def check_invariants(
    t: Tables, *, known_sources: Iterable[str] | None = None, replay: tuple[Tables, Tables] | None = None, vectors: Iterable[tuple[str, str, str]] | None = None
) -> list[Result]:
    """All fifteen invariants, each exactly once, then the five guards.

    ``replay``: tables before and after a second run over unchanged sources.
    ``vectors``: (label, expected, actual) of configuration hashes. What they
    are needed for is not checked without them; a table ``blob`` (blob_key,
    content) is needed to call blob hashes fine.
    """
    from . import snapshot

    out = []
    for name, rules in INVARIANTS.items():
        pairs = [(r.__name__, lambda r=r: r(t)) for r in rules]
        if name == "SINGLE_ACTIVE_VERSION" and known_sources is not None:
            pairs.append(("active_document_in_orphaned_source", lambda: active_document_in_orphaned_source(t, known_sources)))
        if name == "LINEAGE_COMPLETE":
            from .normalize import normalization_findings

            pairs.append(("normalized_input_or_correspondence_invalid", lambda: normalization_findings(t)))
        if name == "HASH_MATCHES_BLOB" and "blob" in t:
            pairs += [("version_blob_hash_mismatch", lambda: version_blob_hash_mismatch(t)), ("artifact_blob_hash_mismatch", lambda: artifact_blob_hash_mismatch(t))]

        def make(name=name, pairs=pairs) -> Result:
            if name in ("IDEMPOTENT_REPLAY", "NO_WORK_WITHOUT_CHANGE"):
                if replay is None:
                    return Result(name, "not_checked", reason="no replay was supplied")
                if name == "NO_WORK_WITHOUT_CHANGE":
                    return _result(name, [("row_written_during_unchanged_rerun", lambda: snapshot.rows_added(*replay))])
                keys = [(f"replay_compared_unattributable_key:{r.__name__}", lambda r=r: r(t)) for r in INVARIANTS["DERIVATION_KEY_MATCHES_MATERIALS"]]
                return _result(name, [*keys, ("replay_state_diff_not_empty", lambda: snapshot.as_findings(snapshot.diff_snapshots(*replay)))])
            if name == "CANONICAL_KEY_STABILITY":
                if vectors is None:
                    return Result(name, "not_checked", reason="no vectors were supplied")
                bad = [{"problem": "config_hash_vector_mismatch", "subject": a, "detail": f"{b} {c}", "of": 1} for a, b, c in vectors if b != c]
                return Result(name, "violated" if bad else "ok", bad)
            result = _result(name, pairs)
            if name == "DELETION_ONLY_FROM_COMPLETED_SCAN" and result.status == "ok":
                unclear = _result(name, [("completion_tombstone_order_unknown", lambda: completion_tombstone_order_unknown(t))])
                if unclear.findings:
                    return Result(name, "not_checked", unclear.findings, "completion and tombstone share a timestamp")
            if name == "HASH_MATCHES_BLOB" and result.status == "ok" and "blob" not in t:
                return Result(name, "not_checked", reason="no blobs were supplied; inline contents matched")
            return result

        out.append(_guarded(name, make))
    if [r.name for r in out] != list(INVARIANTS):
        raise AssertionError("an invariant is missing from the report")
    return out + check_guards(t)


def format_report(results: Iterable[Result]) -> str:
    lines = []
    for r in results:
        lines.append(f"{r.status:<12}{r.name}" + (f" ({r.reason})" if r.reason else ""))
        lines += [f"  {f['problem']}: {f['subject']} {f['detail']}".rstrip() for f in r.findings]
    return "\n".join(lines)


def assert_invariants(results: Iterable[Result], required: Iterable[str], allowed: Iterable[str] = ()) -> None:
    """Fails on a violation that isn't allowed, and on a required check that wasn't made."""
    results, allowed, required = list(results), set(allowed), set(required)
    missing = required - {r.name for r in results}
    bad = [r for r in results if r.status == "violated" and r.name not in allowed or r.status == "not_checked" and r.name in required]
    if bad or missing:
        raise AssertionError(format_report(bad) + "".join(f"\nnot reported: {m}" for m in sorted(missing)))
