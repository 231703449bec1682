"""Queries of the scan lifecycle, of runs, replays and guards as a whole, each with its SQL.

Scans are control rows, so what their lifecycle does with each source's scans
is followed in the driver and shown as a table; documents and the log stay
DataFrames throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, identity, text
from ..operators import audit, derive, normalize, scan, snapshot
from ..schemas import TABLES
from ..sources import office
from . import lineage, packages
from .standin import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = lineage.NOW


def query(sql: str, *tables: str) -> Callable:
    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return put


# --- control rows ------------------------------------------------------------------------

_FIELDS = (
    "scan_id", "source_id", "started_at", "start_seq", "status", "finished_at", "enumerated_count", "distinct_count", "write_failure_count", "unlistable_subtree_count",
    "approved_max_missing_count", "completion_seq", "abort_reason", "deletion_state",
)


def _scans(t: Tables) -> scan.Scans:
    rows = t["scan_run"].select(*_FIELDS).collect()
    return tuple(scan.Scan(count_ratio_threshold_bp=9000, missing_ratio_threshold_bp=1000, **r.asDict()) for r in sorted(rows, key=lambda r: (r.source_id, r.start_seq)))


def _sources(scans: scan.Scans) -> list[str]:
    return sorted({s.source_id for s in scans})


def _shown(t: Tables, rows: Iterable[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(list(rows), schema)


def _refusal(f: Callable[[], object]) -> str | None:
    try:
        f()
    except (errors.StoreError, errors.ConcurrentScanError, errors.StaleScanError, ValueError) as error:
        return type(error).__name__
    return None


@query("""SELECT source_id, CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'ConcurrentScanError' END AS refused, CASE WHEN count(*) FILTER (status = 'running') = 0 THEN max(start_seq) + 1 END AS start_seq,
  CASE WHEN count(*) FILTER (status = 'running') = 0 THEN arg_max(scan_id, completion_seq) END AS baseline, CASE WHEN count(*) FILTER (status = 'running') = 0 THEN coalesce(arg_max(distinct_count, completion_seq), 0) END AS baseline_count,
  arg_min(scan_id, start_seq) FILTER (status = 'running') AS running FROM scan_run GROUP BY source_id""", "scan_run")
def begun_scans(t: Tables) -> DataFrame:
    """A new scan of every source, or why there can't be one."""
    scans, out = _scans(t), []
    names = _sources(scans)
    for name in names:
        running = scan.find_running_scan(scans, name)
        new = None
        refused = _refusal(lambda name=name: scan.begin_scan(scans, name, "new", NOW, sources=names))
        if refused is None:
            _, new = scan.begin_scan(scans, name, "new", NOW, sources=names)
        out.append((name, refused, *((new.start_seq, new.previous_completed_scan_id, new.previous_distinct_count) if new else (None, None, None)), running.scan_id if running else None))
    return _shown(t, out, "source_id string, refused string, start_seq bigint, baseline string, baseline_count bigint, running string")


@query(f"""SELECT scan_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted' ELSE abort_reason END AS abort_reason,
  CASE WHEN status = 'running' THEN {NOW} ELSE finished_at END AS finished_at, CASE WHEN status <> 'running' THEN 'ScanNotRunningError' END AS refused FROM scan_run""", "scan_run")
def failed_scans(t: Tables) -> DataFrame:
    """Every scan closed as interrupted; what has ended already is refused and stays."""
    scans = _scans(t)
    refused = {}
    for s in scans:
        try:
            scans = scan.fail_scan(scans, s.scan_id, "interrupted", NOW)
        except errors.ScanNotRunningError as error:
            refused[s.scan_id] = type(error).__name__
    return _shown(t, [(s.scan_id, s.status, s.abort_reason, s.finished_at, refused.get(s.scan_id)) for s in scans], "scan_id string, status string, abort_reason string, finished_at bigint, refused string")


@query(f"""SELECT scan_id, CASE WHEN status = 'running' THEN start_seq ELSE approved_max_missing_count END AS cap, CASE WHEN status = 'running' THEN 'seen' END AS note, CASE WHEN status = 'running' THEN {NOW} END AS approved_at,
  status = 'running' AND distinct_count > start_seq AND unlistable_subtree_count = 0 AND write_failure_count = 0 AS stopped FROM scan_run""", "scan_run")
def approved_scans(t: Tables) -> DataFrame:
    """Every running scan approved for as many missing documents as its number, and whether its cap then stops it."""
    scans = _scans(t)
    for s in scans:
        if s.status == "running":
            scans = scan.approve_scan(scans, s.scan_id, "seen", s.start_seq, NOW)
    stops = lambda s: s.status == "running" and "approval_missing_limit" in scan.safety_valve(s, s.distinct_count, s.distinct_count).reasons
    return _shown(t, [(s.scan_id, s.approved_max_missing_count, s.approved_note, s.approved_at, stops(s)) for s in scans], "scan_id string, cap bigint, note string, approved_at bigint, stopped boolean")


@query("""SELECT scan_id, CASE WHEN fine THEN NULL ELSE 'StaleScanError' END AS refused FROM (SELECT scan_id,
  coalesce(status = 'completed' AND finished_at IS NOT NULL AND write_failure_count = 0 AND completion_seq = max(completion_seq) OVER (PARTITION BY source_id), false) AS fine FROM scan_run)""", "scan_run")
def deletion_gate(t: Tables) -> DataFrame:
    """Which scans may delete: the last to complete of their source, without write failures."""
    scans = _scans(t)
    return _shown(t, [(s.scan_id, _refusal(lambda s=s: scan.gate_for_deletion(scans, s.scan_id))) for s in scans], "scan_id string, refused string")


@query("""WITH r AS (SELECT *, max(completion_seq) OVER (PARTITION BY source_id) AS last FROM scan_run)
SELECT scan_id, CASE WHEN completion_seq = last THEN 'applied' WHEN completion_seq < last AND deletion_state = 'pending' THEN 'superseded' ELSE deletion_state END AS deletion_state FROM r""", "scan_run")
def deletions_applied(t: Tables) -> DataFrame:
    """Deletion states once the last completed scan of every source has been applied."""
    scans = _scans(t)
    for name in _sources(scans):
        if last := scan.latest_completed(scans, name):
            scans = scan.mark_deletion_applied(scans, last)
    return _shown(t, [(s.scan_id, s.deletion_state) for s in scans], "scan_id string, deletion_state string")


_ABLE = """able AS (SELECT max_by(scan_id, source_id) AS scan_id, max(source_id) AS source_id, max_by(start_seq, source_id) AS start_seq FROM (SELECT *, max(completion_seq) OVER (PARTITION BY source_id) AS last FROM scan_run)
  WHERE status = 'completed' AND completion_seq = last AND write_failure_count = 0),
gone AS (SELECT d.document_id FROM document d JOIN scan_run s ON s.scan_id = d.last_seen_scan_id JOIN able a ON a.source_id = d.source_id AND s.start_seq < a.start_seq WHERE d.state = 'active')"""


@query(f"""WITH {_ABLE} SELECT (SELECT max(observation_seq) FROM observation) + row_number() OVER (ORDER BY document_id, slot) AS observation_seq, CASE slot WHEN 1 THEN 'document_missing' ELSE 'document_tombstoned' END AS kind,
  document_id, scan_id FROM gone, (SELECT unnest([1, 2]) AS slot), able""", "scan_run", "document", "observation")
def deletion_log(t: Tables) -> DataFrame:
    """What applying the deletions of a source's last scan appends to the log."""
    scans = _scans(t)
    last = next((s for n in reversed(_sources(scans)) if (s := scan.latest_completed(scans, n)) and scan.promote(scans, s.scan_id)), None)
    state = scan.State(t["source"], t["document"], t["document_version"], t["observation"], scans=scans)
    if last is not None:
        scan.apply_deletions(state, last, NOW, lambda df: df)
    added = state.added.get("observation", [scan.number_observations(scan.deletion_observations(t["document"].limit(0)).withColumn("enum_seq", F.lit(0)), 0, "none", NOW)])
    return added[0].select("observation_seq", "kind", "document_id", "scan_id")


# --- whole scans -------------------------------------------------------------------------

_TWO_SCANS = f"""SELECT document_id, k AS stable_key, state, sha256('ver:' || strlen(document_id)::VARCHAR || ':' || document_id || '64:' || h) AS active_version_id, last FROM (
  SELECT sha256('doc:3:all' || strlen(k)::VARCHAR || ':' || k) AS document_id, k, CASE WHEN doc_id % 12 = 0 THEN 'tombstoned' ELSE 'active' END AS state,
    sha256(CASE WHEN doc_id % 7 = 1 AND doc_id % 12 <> 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 12 = 0 THEN 'one' ELSE 'two' END AS last
  FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id::VARCHAR || '.txt' AS k FROM documents))"""


def _two_scans(t: Tables) -> tuple[scan.State, list[scan.Report]]:
    """All documents scanned as one source, then again with every twelfth one gone and every seventh changed."""
    empty = {n: t.spark.createDataFrame([], ddl) for n, ddl in TABLES.items()}
    row = [("all", "local-fs", "c", "all", "NFC", False, "posix", True)]
    source = t.spark.createDataFrame(row, "source_id string, kind string, config_hash string, display_name string, key_unicode_form string, key_case_fold boolean, key_path_separator string, key_trim_slashes boolean")
    state = scan.State(source, empty["document"], empty["document_version"], empty["observation"])
    none = lambda kind: F.lit(None).cast(kind)
    d = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def items(rows: DataFrame) -> DataFrame:
        n = F.octet_length("text").cast("bigint")
        outcome = F.struct(
            F.lit("content").alias("kind"), identity.content_hash("text").alias("content_hash"), n.alias("size_bytes"), none("string").alias("error_kind"), none("bigint").alias("declared_size_bytes"), none("bigint").alias("actual_size_bytes"),
        )
        return rows.select(
            F.col("doc_id").cast("bigint").alias("enum_seq"), F.lit("entry").alias("kind"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("stable_key"), F.lit("all").alias("source_id"), outcome.alias("outcome"),
            F.concat_ws(":", F.xxhash64("text").cast("string"), n.cast("string")).alias("quick_fingerprint"), *[none("string").alias(c) for c in ("subtree_key", "error_kind", "reason", "mime_type")],
            *[none("bigint").alias(c) for c in ("link_count", "modified_at")],
        )

    changed = d.where("doc_id % 12 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    reports = [scan.run_scan(state, "all", items(rows), scan_id=name, now_ms=NOW, keep=lambda df: df) for name, rows in (("one", d), ("two", changed))]
    return state, reports


@query(_TWO_SCANS)
def scanned_twice(t: Tables) -> DataFrame:
    """The documents after two whole scans: identities, pointers, tombstones."""
    state, _ = _two_scans(t)
    return state.document.select("document_id", "stable_key", "state", "active_version_id", F.col("last_seen_scan_id").alias("last"))


@query("""WITH d AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 12 = 0) AS gone, count(*) FILTER (doc_id % 7 = 1 AND doc_id % 12 <> 0) AS moved FROM documents)
SELECT 'one' AS scan_id, 'completed' AS status, n AS entries, n AS distinct_count, n AS versions, 0::BIGINT AS deleted, NULL AS baseline, 'applied' AS deletion_state FROM d
UNION ALL SELECT 'two', 'completed', n - gone, n - gone, moved, gone, 'one', 'applied' FROM d""")
def scan_reports(t: Tables) -> DataFrame:
    """What the two scans report: counts, verdict, deletions."""
    state, reports = _two_scans(t)
    scans = {s["scan_id"]: s for s in map(asdict, state.scans)}
    rows = [
        (r.scan.scan_id, scans[r.scan.scan_id]["status"], r.counts["entries"], r.counts["distinct"], r.counts["versions_created"], r.deleted, r.scan.previous_completed_scan_id, scans[r.scan.scan_id]["deletion_state"])
        for r in reports
    ]
    return _shown(t, rows, "scan_id string, status string, entries bigint, distinct_count bigint, versions bigint, deleted bigint, baseline string, deletion_state string")


_KIND = "CASE event_id % 6 WHEN 0 THEN 'entry' WHEN 1 THEN 'hard_linked' WHEN 2 THEN 'not_a_regular_file' WHEN 3 THEN 'unusable_name' WHEN 4 THEN 'unlistable_subtree' ELSE 'office_temporary_file' END"


def _mixed(t: Tables) -> DataFrame:
    """The events as items of all kinds; of some the key is unknown."""
    none = F.lit(None).cast("string")
    kind = F.expr(_KIND)
    key = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("k"), F.col("event_id").cast("string")))
    outcome = F.when(kind == "entry", F.struct(F.lit("content").alias("kind"), F.lit("ab").alias("content_hash"), F.lit(1).cast("bigint").alias("size_bytes"), none.alias("error_kind"), none.cast("bigint").alias("declared_size_bytes"), none.cast("bigint").alias("actual_size_bytes")))
    return t.raw("events").select(F.col("event_id").alias("enum_seq"), kind.alias("kind"), key.alias("stable_key"), none.alias("subtree_key"), none.alias("error_kind"), none.alias("reason"), F.lit(2).cast("bigint").alias("link_count"), outcome.alias("outcome"))


@query(f"""SELECT event_id AS enum_seq, CASE event_id % 6 WHEN 0 THEN 'content' ELSE 'unreadable' END AS outcome, CASE WHEN event_id % 6 <> 0 THEN {_KIND} END AS error_kind FROM events
  WHERE event_id % 6 = 0 OR (event_id % 6 IN (1, 2) AND event_id % 5 <> 0)""")
def observed_entries(t: Tables) -> DataFrame:
    """The items that stand for a document; a skipped one shows that it is still there."""
    return scan.observed_entries(_mixed(t)).select("enum_seq", F.col("outcome.kind").alias("outcome"), F.col("outcome.error_kind").alias("error_kind"))


@query(f"""SELECT event_id AS enum_seq, CASE WHEN event_id % 6 = 4 THEN 'subtree_unlistable' ELSE 'entry_skipped' END AS kind,
  '{{"kind":"' || {_KIND} || '"' || CASE WHEN event_id % 5 <> 0 THEN ',"stableKey":"k' || event_id::VARCHAR || '"' ELSE '' END || ',"linkCount":2}}' AS detail FROM events WHERE event_id % 6 <> 0""")
def skipped_log(t: Tables) -> DataFrame:
    """What the log says of skipped entries and of folders that couldn't be listed."""
    moved, _ = lineage._transitions(t)
    return scan.scan_observations(moved.where("false"), _mixed(t).where("kind <> 'entry'")).select("enum_seq", "kind", "detail")


@query(f"""SELECT doc_id, sha256('doc:' || {lineage._F.format('source_id')} || {lineage._F.format('k')}) AS document_id FROM (SELECT d.doc_id, s.source_id, CASE WHEN s.key_case_fold THEN lower(d.k) ELSE d.k END AS k
  FROM (SELECT doc_id, source, {lineage._KEY} AS k FROM documents) d JOIN source s ON s.source_id = d.source)""", "source")
def policy_document_ids(t: Tables) -> DataFrame:
    """Document ids by the key policy that the source's row holds."""
    items = lineage._entries(t).select("doc_id", F.col("source").alias("source_id"), F.col("k").alias("stable_key"))
    return scan.with_document_ids(items, t["source"]).select("doc_id", "document_id")


@query("SELECT count(*) AS missing FROM document WHERE source_id = 'src4' AND state = 'active' AND last_seen_scan_id <> 'scan-src4-20'", "document")
def missing_count(t: Tables) -> DataFrame:
    return _shown(t, [(scan.count_missing(t["document"], scan.Scan("scan-src4-20", "src4", 0, 20, 9000, 1000)),)], "missing bigint")


# --- runs --------------------------------------------------------------------------------

_LIVE = f"(SELECT min(run_id) FROM processing_run WHERE status = 'leased' AND lease_expires_at > {lineage._LEASE_NOW})"


@query(f"""SELECT run_id, CASE WHEN run_id = {_LIVE} THEN 'failed' ELSE status END AS status, run_id = {_LIVE} OR permanent AS permanent FROM processing_run""", "processing_run")
def completed_run(t: Tables) -> DataFrame:
    """The worker of a live lease ends its run, for good."""
    runs = t["processing_run"]
    first = runs.where(derive.live(lineage._LEASE_NOW)).agg(F.min_by(F.struct("run_id", "worker_id"), "run_id").alias("r")).first()["r"]
    if first:
        runs = derive.complete(runs, first["run_id"], first["worker_id"], "failed", lineage._LEASE_NOW, permanent=True)
    return runs.select("run_id", "status", "permanent")


@query(f"""SELECT run_id, '{{"operation":"commit","workerId":"w0","mismatch":"' || why || '"}}' AS detail FROM (SELECT run_id, CASE WHEN status <> 'leased' THEN 'not_leased' WHEN lease_expires_at <= {lineage._LEASE_NOW} THEN 'lease_expired'
  WHEN worker_id <> 'w0' THEN 'other_worker' END AS why FROM processing_run) WHERE why IS NOT NULL""", "processing_run")
def stale_workers(t: Tables) -> DataFrame:
    """One worker claims to hold every run; the log says where it doesn't."""
    runs = t["processing_run"]
    claims = runs.select("run_id", F.lit("w0").alias("claimed_by"), F.col("derivation_key").alias("claimed_key"))
    return derive.stale_worker_observations(derive.check_leases(claims, runs, lineage._LEASE_NOW), "commit").select("run_id", "detail")


@query("""WITH k AS (SELECT 'key-' || (c_custkey % 700)::VARCHAR AS derivation_key, c_custkey FROM customer), r AS (
  SELECT derivation_key, bool_or(status = 'succeeded') AS won, arg_max(status, (attempt, run_id)) AS latest FROM processing_run GROUP BY derivation_key)
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unsupported' WHEN c_custkey % 700 % 4 = 0 THEN 'ready' WHEN won THEN 'broken' WHEN latest = 'leased' THEN 'waiting' WHEN latest IS NOT NULL THEN 'failed' ELSE 'not_parsed' END AS status
FROM k LEFT JOIN r USING (derivation_key)""", "processing_run")
def derivation_statuses(t: Tables) -> DataFrame:
    """How the results of all kinds of keys stand."""
    number = F.col("c_custkey") % 700
    key = F.concat(F.lit("key-"), number.cast("string"))
    c = t.raw("customer")
    done = c.where(number % 4 == 0).select(key.alias("derivation_key")).distinct()
    return derive.derivation_status(c.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, key).alias("derivation_key")), done, t["processing_run"]).select("c_custkey", "status")


@query("""WITH m AS (SELECT *, sha256('ver:' || doc_id::VARCHAR) AS root, sha256(text) AS h FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN 'form' WHEN 2 THEN 'derivation' WHEN 3 THEN 'input' WHEN 4 THEN 'key' WHEN 5 THEN 'id' WHEN 6 THEN 'count' WHEN 7 THEN 'root' WHEN 8 THEN 'root' WHEN 9 THEN 'content' WHEN 10 THEN 'content'
  WHEN 11 THEN 'run' WHEN 12 THEN 'outputs' END AS problem FROM m""")
def artifact_evidence(t: Tables) -> DataFrame:
    """Documents as derived artifacts, with a defect of every kind."""
    c = F.col
    m = c("doc_id") % 13
    number = c("doc_id").cast("string")
    rows = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("root", identity.sha256(F.concat(F.lit("ver:"), number)))
    rows = rows.withColumn("derivation_key", F.when(m == 4, F.concat(F.lit("k"), number)).otherwise(identity.derivation_key(F.lit("p"), F.lit("1"), F.lit("{}"), F.array("root"))))
    rows = rows.withColumns({"artifact_id": F.when(m == 5, F.concat(F.lit("a"), number)).otherwise(identity.artifact_id("derivation_key", F.lit(0))), "hash": identity.content_hash("text")})
    at, one = F.lit(NOW).cast("bigint").alias("created_at"), F.lit(1).cast("bigint")
    artifacts = rows.select(
        "artifact_id", "derivation_key", F.lit(0).cast("bigint").alias("ordinal"), number.alias("document_id"), F.when(m == 7, "other").otherwise(c("root")).alias("root_version_id"), F.lit("text").alias("type"), c("text").alias("inline_content"),
        F.when(m == 1, "b").alias("blob_key"), F.when(m == 9, "h").otherwise(c("hash")).alias("content_hash"), (F.octet_length("text") + F.when(m == 10, 1).otherwise(0)).cast("bigint").alias("size_bytes"), at,
    )
    outputs = identity.sha256(F.concat(F.lit("out:"), "artifact_id", F.lit(":"), F.when(m == 12, "h").otherwise(c("hash"))))
    inputs = F.when(m == 3, F.to_json(F.array("root", "root"))).otherwise(F.to_json(F.array("root")))
    heads = rows.where(m != 2).select(
        "derivation_key", F.lit("p").alias("processor_name"), F.lit("1").alias("processor_version"), F.lit("{}").alias("config_hash"), inputs.alias("input_ids"), c("root").alias("root_version_id"), number.alias("document_id"),
        F.when(m == 6, 2).otherwise(one).cast("bigint").alias("artifact_count"), outputs.alias("outputs_hash"),
    )
    versions = rows.select(c("root").alias("version_id"), F.when(m == 8, "other").otherwise(number).alias("document_id"))
    runs = rows.select("derivation_key", c("root").alias("root_version_id"), number.alias("document_id"), F.when(m == 11, "failed").otherwise("succeeded").alias("status"))
    out = derive.artifact_evidence({"artifact": artifacts, "derivation": heads, "document_version": versions, "processing_run": runs}, "text", 1 << 30)
    return out.join(rows.select("artifact_id", "doc_id"), "artifact_id").select("doc_id", "problem")


@query("""WITH k AS (SELECT item_id, item_id % 6 AS m FROM benchmark)
SELECT 'n' || item_id::VARCHAR AS subject, CASE m WHEN 1 THEN 'shape' WHEN 2 THEN 'parent' WHEN 3 THEN 'parent' WHEN 4 THEN 'correspondence' ELSE 'parent' END AS detail FROM k WHERE m <> 0""")
def normalized_findings(t: Tables) -> DataFrame:
    """Normalised Word files with planted defects: a blob, no such parent, a run that failed, another content, another root."""
    c, none = F.col, F.lit(None).cast("string")
    m = c("item_id") % 6
    parsed = packages._word(t).withColumn("made", normalize.normalized_column(c("content"))["content"])
    ident = c("item_id").cast("string")
    put = lambda prefix, kind, content, blob, root: parsed.select(
        F.concat(F.lit(prefix), ident).alias("artifact_id"), F.concat(F.lit(f"k{prefix}"), ident).alias("derivation_key"), F.lit(kind).alias("type"), F.lit(0).cast("bigint").alias("ordinal"), blob.alias("blob_key"),
        content.alias("inline_content"), identity.content_hash(content).alias("content_hash"), F.octet_length(content).cast("bigint").alias("size_bytes"), root.alias("root_version_id"), F.lit("d").alias("document_id"),
    )
    old = put("p", "parsed_document", c("content"), none, F.lit("v"))
    new = put("n", "normalized_document", F.when(m == 4, F.concat("made", F.lit(" "))).otherwise(c("made")), F.when(m == 1, "b"), F.when(m == 5, "w").otherwise("v"))
    one = F.lit(1).cast("bigint").alias("artifact_count")
    heads = parsed.select(F.concat(F.lit("kp"), ident).alias("derivation_key"), F.lit(office.PARSER_NAME).alias("processor_name"), F.lit("c").alias("config_hash"), F.lit("[]").alias("input_ids"), one)
    parent = F.concat(F.lit("p"), ident, F.when(m == 2, "x").otherwise(""))
    heads = heads.unionByName(parsed.select(F.concat(F.lit("kn"), ident).alias("derivation_key"), F.lit(normalize.NORMALIZER_NAME).alias("processor_name"), F.lit(normalize.config_hash()).alias("config_hash"), F.to_json(F.array(parent)).alias("input_ids"), one))
    runs = parsed.select(F.concat(F.lit("kp"), ident).alias("derivation_key"), F.when(m == 3, "failed").otherwise("succeeded").alias("status"))
    return normalize.normalization_findings({"artifact": old.unionByName(new), "derivation": heads, "processing_run": runs})


# --- snapshots and guards ----------------------------------------------------------------


@query("SELECT document_id AS key, state, active_version_id, tombstoned_at::VARCHAR AS tombstoned_at, 7 AS cells FROM document", "document")
def state_snapshot(t: Tables) -> DataFrame:
    """Documents as replays compare them, without what any scan moves."""
    s = snapshot.snapshot_state({"document": t["document"]})["document"]
    return s.select("key", *[F.element_at("cells", F.lit(c)).alias(c) for c in ("state", "active_version_id", "tombstoned_at")], F.size("cells").alias("cells"))


@query("""SELECT 'document_version[' || version_id || ']' AS subject FROM document_version WHERE version_id < '2' UNION ALL SELECT 'derivation[' || derivation_key || ']' FROM derivation WHERE derivation_key < '2'
UNION ALL SELECT 'artifact[' || artifact_id || ']' FROM artifact WHERE artifact_id LIKE 'art-1%'""", "document_version", "derivation", "artifact")
def rows_added(t: Tables) -> DataFrame:
    """Rows of the content tables that a second run wrote."""
    after = {n: t[n] for n in snapshot.CONTENT_TABLES}
    before = {
        "document_version": after["document_version"].where("version_id >= '2'"), "derivation": after["derivation"].where("derivation_key >= '2'"), "artifact": after["artifact"].where("artifact_id NOT LIKE 'art-1%'"),
    }
    return snapshot.rows_added(before, after).select("subject")


@query("""SELECT 'document ' || document_id || ' ' || change AS subject, col AS detail FROM (SELECT document_id, 'changed' AS change, unnest(['state', 'tombstoned_at']) AS col FROM document WHERE state = 'tombstoned'
  UNION ALL SELECT document_id, 'removed', '' FROM document WHERE state = 'quarantined')""", "document")
def replay_findings(t: Tables) -> DataFrame:
    """The documents against a state in which what was deleted is back and what was quarantined is gone."""
    d = t["document"]
    dead = F.col("state") == "tombstoned"
    after = d.where("state <> 'quarantined'").withColumns({"state": F.when(dead, "active").otherwise(F.col("state")), "tombstoned_at": F.lit(None).cast("bigint"), "last_seen_at": F.col("last_seen_at") + 1})
    return snapshot.as_findings(snapshot.diff_snapshots({"document": d}, {"document": after}))


def _twice(rule: str, problem: str, table: str, *keys: str, where: str = "true") -> str:
    subject = " || '|' || ".join(f"{k}::VARCHAR" for k in keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT '{rule}' AS invariant, '{problem}' AS problem, {subject} AS subject, count(*)::VARCHAR AS detail FROM {table} WHERE {where} AND {known} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


_INDEXES, _UNIQUE = audit.GUARDS[:2]


@query(" UNION ALL ".join([
    _twice(_INDEXES, "one_running_scan", "scan_run", "source_id", where="status = 'running'"), _twice(_INDEXES, "one_leased_run", "processing_run", "derivation_key", where="status = 'leased'"),
    _twice(_INDEXES, "scan_completion_seq", "scan_run", "source_id", "completion_seq"), _twice(_UNIQUE, "document(source_id, stable_key)", "document", "source_id", "stable_key"),
    _twice(_UNIQUE, "document_version(document_id, content_hash)", "document_version", "document_id", "content_hash"), _twice(_UNIQUE, "artifact(derivation_key, ordinal)", "artifact", "derivation_key", "ordinal"),
    _twice(_UNIQUE, "observation(observation_id)", "observation", "observation_id"), _twice("OBSERVATION_TOTAL_ORDER", "total_order_column_is_not_primary_key", "observation", "observation_seq"),
    "SELECT 'DOCUMENT_VERSION_IMMUTABLE_TRIGGER', 'version_rewritten', version_id, count(DISTINCT (document_id, content_hash, size_bytes))::VARCHAR FROM document_version GROUP BY version_id HAVING count(DISTINCT (document_id, content_hash, size_bytes)) > 1",
    _twice("ONE_LEASED_RUN_PER_KEY", "multiple_leased_runs_for_key", "processing_run", "derivation_key", where="status = 'leased'"),
]), "scan_run", "processing_run", "document", "document_version", "artifact", "observation")
def guard_findings(t: Tables) -> DataFrame:
    """All findings of the guards that stand for a schema's constraints."""
    found = audit.all_findings(audit.check_guards(t))
    return found if found is not None else _shown(t, [], "invariant string, problem string, subject string, detail string")


# --- scalars -----------------------------------------------------------------------------


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey::VARCHAR || ',"name":"' || n_name || '","nested":{"list":[1,"' || n_name || '"],"on":' || (n_regionkey > 1)::VARCHAR || '}}') AS config_hash FROM nation""")
def config_hashes(t: Tables) -> DataFrame:
    """Hashes of configurations, whose members may come in any order; configurations are control data."""
    rows = t.raw("nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    made = [(r[0], identity.canonical_config_hash({"nested": {"on": r[2] > 1, "list": [1, r[1]]}, "name": r[1], "key": r[0], "left out": identity.UNDEFINED})) for r in rows]
    return _shown(t, made, f"n_nationkey {dict(t.raw('nation').dtypes)['n_nationkey']}, config_hash string")


@query("SELECT o_orderkey, o_orderkey::BIGINT * 1000 AS at FROM orders")
def epoch_times(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", identity.epoch_ms(F.col("o_orderkey").cast("double") * 1000).alias("at"))


@query("SELECT p_partkey FROM part WHERE contains(p_name || '_' || p_size::VARCHAR || '%!', '_1%!') OR contains(p_name || '_' || p_size::VARCHAR || '%!', '_2%!')")
def escaped_patterns(t: Tables) -> DataFrame:
    """Substrings that hold a pattern's own signs."""
    name = F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit("%!"))
    like = lambda q: F.expr(f"name LIKE '{text.like_pattern(q)}' ESCAPE '!'")
    return t.raw("part").withColumn("name", name).where(like("_1%!") | like("_2%!")).select("p_partkey")
