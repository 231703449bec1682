"""The scan lifecycle, a scan at a time instead of an entry at a time.

What an entry does depends on the entries of the same document before it in the
scan. A window over each document's entries, in the order they were enumerated,
gives every entry what it would have found; all observations, versions and
pointer moves then follow from joins with the tables as they were.

``Scan`` rows are control data (a few per source) and live in the driver as
plain rows; documents, versions and observations never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors, identity
from ..functions.text import normalize_key

COUNT_RATIO_BP, MISSING_RATIO_BP = 9000, 1000
FULL_BP = 10_000
#: Entries that one task numbers.
NUMBERED = 100_000

OBSERVATION_SCHEMA = "observation_seq bigint, observation_id string, kind string, document_id string, version_id string, scan_id string, run_id string, occurred_at bigint, detail string"
SKIPPED = ("not_a_regular_file", "hard_linked", "unusable_name", "vanished_during_scan", "office_temporary_file")
#: Skipped entries that still show their document is there.
STILL_THERE = ("hard_linked", "not_a_regular_file", "vanished_during_scan")


@dataclass(frozen=True)
class Scan:
    scan_id: str
    source_id: str
    started_at: int
    start_seq: int
    count_ratio_threshold_bp: int
    missing_ratio_threshold_bp: int
    status: str = "running"
    finished_at: int | None = None
    enumerated_count: int = 0
    distinct_count: int = 0
    previous_completed_scan_id: str | None = None
    previous_distinct_count: int = 0
    write_failure_count: int = 0
    unlistable_subtree_count: int = 0
    approved_at: int | None = None
    approved_note: str | None = None
    approved_max_missing_count: int | None = None
    completion_seq: int | None = None
    abort_reason: str | None = None
    deletion_state: str | None = None


Scans = tuple[Scan, ...]


def _one(scans: Scans, scan_id: str) -> Scan:
    for s in scans:
        if s.scan_id == scan_id:
            return s
    raise errors.NotFoundError(f"no scan {scan_id}")


def _put(scans: Scans, scan: Scan) -> Scans:
    return tuple(scan if s.scan_id == scan.scan_id else s for s in scans)


def latest_completed(scans: Scans, source_id: str) -> Scan | None:
    """By the order of completion; aborted and failed scans are no baseline."""
    return max((s for s in scans if s.source_id == source_id and s.status == "completed"), key=lambda s: s.completion_seq, default=None)


def begin_scan(scans: Scans, source_id: str, scan_id: str, now_ms: int, *, count_bp: int = COUNT_RATIO_BP, missing_bp: int = MISSING_RATIO_BP, sources: Iterable[str]) -> tuple[Scans, Scan]:
    for bp in (count_bp, missing_bp):
        if isinstance(bp, bool) or not isinstance(bp, int) or not 0 <= bp <= FULL_BP:
            raise ValueError("thresholds are whole basis points from 0 to 10000")
    if source_id not in set(sources):
        raise errors.NotFoundError(f"no source {source_id}")
    own = [s for s in scans if s.source_id == source_id]
    if any(s.status == "running" for s in own):
        raise errors.ConcurrentScanError(f"a scan of {source_id} is running")
    base = latest_completed(scans, source_id)
    scan = Scan(
        scan_id, source_id, now_ms, max((s.start_seq for s in own), default=0) + 1, count_bp, missing_bp,
        previous_completed_scan_id=base.scan_id if base else None, previous_distinct_count=base.distinct_count if base else 0,
    )
    return (*scans, scan), scan


def _running(scans: Scans, scan_id: str) -> Scan:
    scan = _one(scans, scan_id)
    if scan.status != "running":
        raise errors.ScanNotRunningError(f"scan {scan_id} is {scan.status}")
    return scan


def approve_scan(scans: Scans, scan_id: str, note: str, most_missing: int, now_ms: int) -> Scans:
    """For this scan only, and once; the thresholds stay."""
    scan = _running(scans, scan_id)
    if not note.strip() or isinstance(most_missing, bool) or not isinstance(most_missing, int) or most_missing < 0:
        raise ValueError("an approval needs a note and a whole cap of at least 0")
    if scan.approved_at is not None:
        raise ValueError("the scan is approved already")
    return _put(scans, replace(scan, approved_at=now_ms, approved_note=note, approved_max_missing_count=most_missing))


def fail_scan(scans: Scans, scan_id: str, reason: str, now_ms: int) -> Scans:
    if not reason.strip():
        raise ValueError("a failure needs a reason")
    return _put(scans, replace(_running(scans, scan_id), status="failed", finished_at=now_ms, abort_reason=reason))


def find_running_scan(scans: Scans, source_id: str) -> Scan | None:
    return next((s for s in scans if s.source_id == source_id and s.status == "running"), None)


# --- the safety valve --------------------------------------------------------------------


@dataclass(frozen=True)
class Verdict:
    passes: bool
    reasons: tuple[str, ...]
    excused: tuple[str, ...] = ()


def safety_valve(scan: Scan, distinct: int, missing: int, write_failures: int = 0) -> Verdict:
    """Whether a scan may complete. Whole numbers only; the boundaries themselves pass."""
    failed, unlisted = max(scan.write_failure_count, write_failures), scan.unlistable_subtree_count
    reasons = []
    if failed or unlisted:
        reasons += ["write_failures"] * (failed > 0) + ["unlistable_subtree"] * (unlisted > 0)
    elif scan.previous_distinct_count > 0:
        if distinct * FULL_BP < scan.previous_distinct_count * scan.count_ratio_threshold_bp:
            reasons.append("count_ratio")
        if missing * FULL_BP > scan.previous_distinct_count * scan.missing_ratio_threshold_bp:
            reasons.append("missing_ratio")
    approved = scan.approved_max_missing_count is not None
    if approved and not failed and not unlisted and missing > scan.approved_max_missing_count:
        reasons.append("approval_missing_limit")
    hard = {"write_failures", "unlistable_subtree", "approval_missing_limit"}
    excused = approved and bool(reasons) and not hard.intersection(reasons)
    return Verdict(not reasons or excused, tuple(sorted(reasons)), tuple(sorted(reasons)) if excused else ())


def valve_columns(distinct: Column, missing: Column, previous: Column, count_bp: int = COUNT_RATIO_BP, missing_bp: int = MISSING_RATIO_BP) -> Column:
    """The ratio part of the valve for many scans at once: the reasons joined by commas, ``ok``, or ``first`` without a baseline."""
    low = distinct * FULL_BP < previous * count_bp
    many = missing * FULL_BP > previous * missing_bp
    reasons = F.concat_ws(",", F.when(low, "count_ratio"), F.when(many, "missing_ratio"))
    return F.when(previous.isNull() | (previous <= 0), "first").when(low | many, reasons).otherwise("ok")


def count_missing(documents: DataFrame, scan: Scan) -> int:
    return documents.where((F.col("source_id") == scan.source_id) & (F.col("state") == "active") & (F.col("last_seen_scan_id") != scan.scan_id)).count()


# --- ingestion ---------------------------------------------------------------------------


def observed_entries(items: DataFrame) -> DataFrame:
    """The items that stand for a document: readable entries, and skipped ones that show it is still there (as unreadable)."""
    skipped = F.col("kind").isin(*STILL_THERE) & F.col("stable_key").isNotNull()
    struct = "struct<kind:string,content_hash:string,size_bytes:bigint,error_kind:string,declared_size_bytes:bigint,actual_size_bytes:bigint>"
    none = lambda t: F.lit(None).cast(t)
    unreadable = F.struct(F.lit("unreadable"), none("string"), none("bigint"), F.col("kind"), none("bigint"), none("bigint")).cast(struct)
    return items.where((F.col("kind") == "entry") | skipped).withColumn("outcome", F.when(F.col("kind") == "entry", F.col("outcome").cast(struct)).otherwise(unreadable))


def with_document_ids(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids by the key policy of the source's stored row, which alone decides."""
    policy = sources.select("source_id", "key_unicode_form", "key_case_fold", "key_path_separator", "key_trim_slashes")
    norm = normalize_key("stable_key", "key_unicode_form", "key_case_fold", "key_path_separator", "key_trim_slashes")
    return items.join(policy, "source_id").withColumn("document_id", identity.document_id("source_id", norm)).drop(*policy.columns[1:])


def transitions(entries: DataFrame, documents: DataFrame, versions: DataFrame, created_before: DataFrame, scan_id: str) -> DataFrame:
    """What each entry meets and does.

    ``entries``: document_id, enum_seq, stable_key, outcome, quick_fingerprint.
    ``created_before``: version_id of every version the log has as created.
    Adds flags (collides, discovered, revived, same_print), known_hash, the
    version_id of readable contents, whether the pointer moves to it, and
    whether that is a creation.
    """
    active = versions.select(F.col("version_id").alias("active_version_id"), F.col("content_hash").alias("active_hash"))
    before = documents.join(active, "active_version_id", "left").select(
        "document_id", F.lit(True).alias("existed"), F.col("state").alias("old_state"), F.col("stable_key").alias("old_key"),
        F.col("last_seen_scan_id").alias("old_scan"), F.col("last_fingerprint").alias("old_print"), F.col("active_hash").alias("old_hash"),
    )
    w = Window.partitionBy("document_id").orderBy("enum_seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    readable = F.when(F.col("outcome.kind") == "content", F.col("outcome.content_hash"))
    e = entries.join(before, "document_id", "left").withColumn("nth", F.row_number().over(w)).withColumn("hash", readable)
    e = e.withColumn("known_hash", F.coalesce(F.last("hash", ignorenulls=True).over(past), "old_hash"))
    e = e.withColumn("known_print", F.coalesce(F.last("quick_fingerprint", ignorenulls=True).over(past), "old_print"))
    e = e.withColumn("known_key", F.coalesce(F.lag("stable_key").over(w), F.when(F.col("old_scan") == scan_id, F.col("old_key"))))
    here = F.coalesce("existed", F.lit(False))
    e = e.withColumns({
        "collides": F.coalesce(F.col("known_key") != F.col("stable_key"), F.lit(False)),
        "discovered": (F.col("nth") == 1) & ~here,
        "revived": (F.col("nth") == 1) & F.coalesce(F.col("old_state") == "tombstoned", F.lit(False)),
        "same_print": F.coalesce((F.col("hash") != F.col("known_hash")) & (F.col("known_print") == F.col("quick_fingerprint")), F.lit(False)),
        "version_id": F.when(F.col("hash").isNotNull(), identity.version_id("document_id", F.coalesce("hash", F.lit("0")))),
        "moves": F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("known_hash")),
    })
    told = created_before.select("version_id").where("version_id IS NOT NULL").distinct().withColumn("told", F.lit(True))
    e = e.join(told, "version_id", "left")
    again = F.row_number().over(Window.partitionBy("document_id", "version_id", "moves").orderBy("enum_seq"))
    return e.withColumn("creates", F.col("moves") & F.col("told").isNull() & (again == 1)).drop("told", "existed", "nth")


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))


def scan_observations(moved: DataFrame, skipped: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(enum_seq, slot, kind, document_id, version_id, detail), in the order an entry at a time would have written them."""
    c = F.col
    row = lambda slot, kind, when, detail, version=None: F.when(
        when, F.struct(F.lit(slot).alias("slot"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (version if version is not None else F.lit(None).cast("string")).alias("version_id"), detail.alias("detail"))
    )
    empty = F.lit("{}")
    slots = [
        row(1, "stable_key_collision", c("collides"), _json(existingStableKey=c("known_key"), incomingStableKey=c("stable_key"))),
        row(2, F.when(c("discovered"), "document_discovered").otherwise("document_revived"), c("discovered") | c("revived"), F.when(c("discovered"), _json(stableKey=c("stable_key"))).otherwise(empty)),
        row(4, "fingerprint_collision", c("same_print"), _json(quickFingerprint=c("quick_fingerprint"), knownHash=c("known_hash"), observedHash=c("hash"))),
        row(5, "document_unreadable", c("outcome.kind") == "unreadable", _json(errorKind=c("outcome.error_kind"))),
        row(5, "size_mismatch_rejected", c("outcome.kind") == "size_mismatch", _json(declaredSizeBytes=c("outcome.declared_size_bytes"), actualSizeBytes=c("outcome.actual_size_bytes"))),
        row(6, F.when(c("creates"), "version_created").otherwise("version_reverted"), c("moves"), empty, c("version_id")),
    ]
    out = moved.select("enum_seq", "document_id", F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s")).select("enum_seq", "s.slot", "s.kind", "document_id", "s.version_id", "s.detail")
    told = skipped.select(
        "enum_seq", F.lit(0).alias("slot"), F.when(c("kind") == "unlistable_subtree", "subtree_unlistable").otherwise("entry_skipped").alias("kind"), F.lit(None).cast("string").alias("document_id"),
        F.lit(None).cast("string").alias("version_id"), _json(kind=c("kind"), stableKey=c("stable_key"), subtreeKey=c("subtree_key"), errorKind=c("error_kind"), reason=c("reason"), linkCount=c("link_count")).alias("detail"),
    )
    out = out.unionByName(told)
    if renames is not None:
        touched = renames.where("resolution = 'confirmed_rename'").select(F.explode(F.array("disappeared_document_id", "appeared_document_id")).alias("document_id")).groupBy("document_id").count()
        re = moved.where("revived").select("enum_seq", "document_id").join(touched, "document_id")
        out = out.unionByName(re.select("enum_seq", F.lit(3).alias("slot"), F.lit("rename_needs_recheck").alias("kind"), "document_id", F.lit(None).cast("string").alias("version_id"), _json(count=c("count")).alias("detail")))
    return out


def in_hex_order(rows: DataFrame, digest: str, n: int) -> DataFrame:
    """``rows`` (``n`` of them) with ``enum_seq`` in the order of a column of hex digests.

    The first digits cut the order into even stretches, each with room for all rows.
    """
    order = F.row_number().over(Window.partitionBy(F.substring(digest, 1, 3)).orderBy(digest))
    room = (n // NUMBERED + 1) * NUMBERED
    return rows.withColumn("enum_seq", F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint") * room + order)


def number_observations(rows: DataFrame, base: int, scan_id: str | None, now_ms: int) -> DataFrame:
    """Dense sequence numbers after ``base`` in the order of (enum_seq, slot), without one task seeing all rows.

    Rows are numbered within stretches of enum_seq; the stretches' sizes are a small table.
    Rows that belong to runs instead of a scan have their ``run_id``.
    """
    rows = rows.withColumn("part", F.floor(F.col("enum_seq") / NUMBERED))
    sizes = rows.groupBy("part").count()
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    seq = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("enum_seq", "slot", "document_id")) + base
    out = rows.join(offsets, "part").withColumn("observation_seq", seq)
    ident = F.concat_ws("-", F.lit(scan_id or "run"), F.col("observation_seq").cast("string"))
    run = F.col("run_id") if "run_id" in rows.columns else F.lit(None)
    return out.select("observation_seq", ident.alias("observation_id"), "kind", "document_id", "version_id", F.lit(scan_id).cast("string").alias("scan_id"), run.cast("string").alias("run_id"), F.lit(now_ms).cast("bigint").alias("occurred_at"), "detail")


def merge_documents(documents: DataFrame, moved: DataFrame, scan: Scan, now_ms: int) -> DataFrame:
    """The document table after the entries: new rows, and the seen ones' key, state, pointer and fingerprint."""
    last = lambda col, when=None: F.max_by(F.struct(F.col(col).alias("v")), F.when(F.lit(True) if when is None else when, F.col("enum_seq")))["v"].alias(f"new_{col}")
    seen = moved.groupBy("document_id").agg(
        last("stable_key"), last("quick_fingerprint", F.col("quick_fingerprint").isNotNull()), last("version_id", F.col("moves")), F.first("source_id").alias("new_source")
    )
    now = F.lit(now_ms).cast("bigint")
    j = documents.withColumn("old", F.lit(True)).join(seen.withColumn("seen", F.lit(True)), "document_id", "full_outer")
    s = F.col("seen").isNotNull()
    pick = lambda new, old: F.when(s, new).otherwise(F.col(old)).alias(old)
    fresh = s & F.col("new_quick_fingerprint").isNotNull()
    return j.select(
        "document_id", F.coalesce("source_id", "new_source").alias("source_id"), pick(F.col("new_stable_key"), "stable_key"),
        F.when(s & (F.col("old").isNull() | (F.col("state") == "tombstoned")), "active").otherwise(F.col("state")).alias("state"),
        F.coalesce("new_version_id", "active_version_id").alias("active_version_id"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
        pick(now, "last_seen_at"), pick(F.lit(scan.scan_id), "last_seen_scan_id"), F.coalesce("new_quick_fingerprint", "last_fingerprint").alias("last_fingerprint"),
        F.when(fresh, now).otherwise(F.col("last_fingerprint_at")).alias("last_fingerprint_at"),
        F.when(s & (F.col("state") == "tombstoned"), F.lit(None)).otherwise(F.col("tombstoned_at")).cast("bigint").alias("tombstoned_at"),
    )


def new_versions(moved: DataFrame, versions: DataFrame, scan: Scan, now_ms: int, pipeline_version: str = "v0.1") -> DataFrame:
    """Rows for contents that no version of the document has yet; an existing version is left as it is."""
    first = moved.where("hash IS NOT NULL").groupBy("version_id").agg(
        F.min_by(F.struct("document_id", "hash", "outcome", F.col("mime_type"), F.col("modified_at")), "enum_seq").alias("e")
    )
    now = F.lit(now_ms).cast("bigint")
    rows = first.select(
        "version_id", "e.document_id", F.col("e.hash").alias("content_hash"), F.col("e.outcome.size_bytes").alias("size_bytes"), F.col("e.hash").alias("blob_key"), now.alias("blob_verified_at"),
        F.coalesce("e.mime_type", F.lit("application/octet-stream")).alias("mime_type"), F.col("e.modified_at").alias("source_modified_at"), now.alias("ingested_at"),
        F.lit(scan.scan_id).alias("discovered_by_scan_id"), F.lit(pipeline_version).alias("pipeline_version"),
    )
    return insert_if_absent(rows, versions, "version_id")


def insert_if_absent(rows: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    return rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")


def recheck_renames(renames: DataFrame, revived: DataFrame) -> DataFrame:
    """Confirmed renames that touch a revived document need to be looked at again."""
    ids = revived.select("document_id").distinct()
    one = ids.select(F.col("document_id").alias("disappeared_document_id"), F.lit(True).alias("a"))
    two = ids.select(F.col("document_id").alias("appeared_document_id"), F.lit(True).alias("b"))
    j = renames.join(one, "disappeared_document_id", "left").join(two, "appeared_document_id", "left")
    hit = (F.col("a").isNotNull() | F.col("b").isNotNull()) & (F.col("resolution") == "confirmed_rename")
    return j.withColumn("resolution", F.when(hit, "needs_recheck").otherwise(F.col("resolution"))).select(*renames.columns)


# --- deletions ---------------------------------------------------------------------------


def promote(scans: Scans, scan_id: str) -> Scan | None:
    """The scan if deletions may follow from it: completed without write failures, and the latest to complete."""
    scan = _one(scans, scan_id)
    last = latest_completed(scans, scan.source_id)
    fine = scan.status == "completed" and scan.finished_at is not None and scan.completion_seq is not None and scan.write_failure_count == 0
    return scan if fine and last is not None and last.scan_id == scan_id else None


def gate_for_deletion(scans: Scans, scan_id: str) -> Scan:
    """As ``promote``, from the stored row whatever the caller holds; refuses instead of returning nothing."""
    scan = promote(scans, scan_id)
    if scan is None:
        raise errors.StaleScanError(f"scan {scan_id} may not delete")
    return scan


def find_missing(documents: DataFrame, scans: DataFrame, scan: Scan) -> DataFrame:
    """Active documents of the source last seen by a scan that began before this one. ``scans``: scan_id, start_seq."""
    began = scans.select(F.col("scan_id").alias("last_seen_scan_id"), "start_seq")
    rows = documents.where((F.col("source_id") == scan.source_id) & (F.col("state") == "active"))
    return rows.join(began, "last_seen_scan_id").where(F.col("start_seq") < scan.start_seq).select(*documents.columns)


def tombstone(documents: DataFrame, missing: DataFrame, now_ms: int) -> DataFrame:
    gone = missing.select("document_id").distinct().withColumn("gone", F.lit(True))
    j = documents.join(gone, "document_id", "left")
    hit = F.col("gone").isNotNull()
    j = j.withColumn("state", F.when(hit, "tombstoned").otherwise(F.col("state"))).withColumn("tombstoned_at", F.when(hit, F.lit(now_ms).cast("bigint")).otherwise(F.col("tombstoned_at")))
    return j.select(*documents.columns)


def deletion_observations(missing: DataFrame) -> DataFrame:
    """For each missing document that it is missing and then its tombstone, in order of ids."""
    kinds = F.array(F.struct(F.lit(1).alias("slot"), F.lit("document_missing").alias("kind")), F.struct(F.lit(2).alias("slot"), F.lit("document_tombstoned").alias("kind")))
    return missing.select("document_id", F.explode(kinds).alias("s")).select("document_id", "s.slot", "s.kind", F.lit(None).cast("string").alias("version_id"), F.lit("{}").alias("detail"))


def find_pending_deletion(scans: Scans, source_id: str) -> str | None:
    last = latest_completed(scans, source_id)
    return last.scan_id if last and last.deletion_state == "pending" else None


def mark_deletion_applied(scans: Scans, scan: Scan) -> Scans:
    def mark(s: Scan) -> Scan:
        if s.scan_id == scan.scan_id:
            return replace(s, deletion_state="applied")
        older = s.source_id == scan.source_id and s.status == "completed" and s.completion_seq < scan.completion_seq
        return replace(s, deletion_state="superseded") if older and s.deletion_state == "pending" else s

    return tuple(map(mark, scans))


def orphaned_sources(documents: DataFrame, known: Iterable[str]) -> DataFrame:
    rows, names = documents.where("state = 'active'").select("source_id").distinct(), list(known)
    return (rows.where(~F.col("source_id").isin(names)) if names else rows).orderBy("source_id")


# --- a whole scan ------------------------------------------------------------------------


@dataclass
class State:
    """The tables, and the scans as rows. DataFrames here should be written down between steps (``keep`` of ``run_scan``).

    ``added``: the rows by which tables grew since they were last stored, of those tables that only grow.
    """

    source: DataFrame
    document: DataFrame
    document_version: DataFrame
    observation: DataFrame
    rename_candidate: DataFrame | None = None
    scans: Scans = ()
    added: dict[str, list[DataFrame]] = field(default_factory=dict)

    def grow(self, name: str, rows: DataFrame) -> None:
        setattr(self, name, getattr(self, name).unionByName(rows, allowMissingColumns=True))
        self.added.setdefault(name, []).append(rows)


@dataclass
class Report:
    scan: Scan
    verdict: Verdict | None
    counts: dict[str, int] = field(default_factory=dict)
    deleted: int = 0
    resumed: int = 0


def _append(state: State, rows: DataFrame, scan_id: str, now_ms: int, keep: Callable[[DataFrame], DataFrame]) -> None:
    base = state.observation.agg(F.coalesce(F.max("observation_seq"), F.lit(0))).first()[0]
    state.grow("observation", keep(number_observations(rows, base, scan_id, now_ms)))


def ingest(state: State, scan: Scan, items: DataFrame, now_ms: int, keep: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Applies a scan's items to the tables; works on the processed part alone if the enumeration broke off."""
    items = keep(items)
    skipped = items.where(F.col("kind") != "entry")
    entries = with_document_ids(observed_entries(items), state.source)
    created = state.observation.where("kind = 'version_created'").select("version_id")
    moved = keep(transitions(entries, state.document, state.document_version, created, scan.scan_id))
    versions = keep(new_versions(moved, state.document_version, scan, now_ms))
    told = scan_observations(moved, skipped, state.rename_candidate)
    if state.rename_candidate is not None:
        state.rename_candidate = keep(recheck_renames(state.rename_candidate, moved.where("revived")))
    state.document = keep(merge_documents(state.document, moved, scan, now_ms))
    state.grow("document_version", versions)
    _append(state, told, scan.scan_id, now_ms, keep)
    n = moved.agg(
        F.count(F.lit(1)), F.countDistinct("document_id"), *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)) for c in ("discovered", "revived", "creates", "collides", "same_print")],
        F.coalesce(F.sum((F.col("outcome.kind") != "content").cast("bigint")), F.lit(0)), F.coalesce(F.sum((F.col("moves") & ~F.col("creates")).cast("bigint")), F.lit(0)),
    ).first()
    unlistable = skipped.where("kind = 'unlistable_subtree'").count()
    keyless = skipped.where(F.col("kind").isin("unusable_name", "office_temporary_file")).count()
    names = ("entries", "distinct", "discovered", "revived", "versions_created", "collisions", "fingerprint_collisions", "not_read", "reverted")
    return dict(zip(names, n)) | {"unlistable": unlistable, "enumerated": n[0] + keyless}


def finish_scan(state: State, scan_id: str, enumerated: int, distinct: int, now_ms: int, write_failures: int = 0) -> Verdict:
    """Completes or aborts the running scan by the valve; what was ingested stays either way."""
    scan = _running(state.scans, scan_id)
    if distinct > enumerated:
        raise ValueError("more distinct documents than entries")
    verdict = safety_valve(scan, distinct, count_missing(state.document, scan), write_failures)
    done: dict[str, Any] = {"finished_at": now_ms, "enumerated_count": enumerated, "distinct_count": distinct, "write_failure_count": max(scan.write_failure_count, write_failures)}
    if verdict.passes:
        seq = max((s.completion_seq or 0 for s in state.scans if s.source_id == scan.source_id), default=0) + 1
        done |= {"status": "completed", "completion_seq": seq, "deletion_state": "pending"}
    else:
        done |= {"status": "aborted_safety", "abort_reason": ",".join(verdict.reasons)}
    state.scans = _put(state.scans, replace(scan, **done))
    return verdict


def apply_deletions(state: State, scan: Scan, now_ms: int, keep: Callable[[DataFrame], DataFrame]) -> int:
    """Tombstones what the scan didn't see; the missing set is fixed before anything is written."""
    scan = gate_for_deletion(state.scans, scan.scan_id)
    spark = state.document.sparkSession
    began = spark.createDataFrame([(s.scan_id, s.start_seq) for s in state.scans], "scan_id string, start_seq bigint")
    missing = keep(find_missing(state.document, began, scan))
    n = missing.count()
    if n:
        rows = deletion_observations(missing)
        ordered = in_hex_order(missing.select("document_id"), "document_id", n)
        state.document = keep(tombstone(state.document, missing, now_ms))
        _append(state, rows.join(ordered, "document_id"), scan.scan_id, now_ms, keep)
    state.scans = mark_deletion_applied(state.scans, scan)
    return n


def run_scan(
    state: State, source_id: str, items: DataFrame, *, scan_id: str, now_ms: int, keep: Callable[[DataFrame], DataFrame], count_bp: int = COUNT_RATIO_BP, missing_bp: int = MISSING_RATIO_BP,
    write_failures: int = 0, interrupted: str | None = None, review: Callable[[Scan, int], tuple[str, int] | None] | None = None, step: Callable[[], None] = lambda: None,
) -> Report:
    """One scan of a source, from recovery to deletions.

    ``interrupted`` names a running scan to be closed first; a deletion that was
    left pending is resumed; then the scan begins, its items are ingested,
    ``review`` may approve it (a note and a cap of missing documents), and the
    valve decides. ``keep`` writes a DataFrame down and reads it again; ``step``
    is called whenever the state is one that should outlast what follows: once the
    scan runs, after the ingestion, the verdict and the deletions, and on failure.
    """
    if interrupted is not None:
        state.scans = fail_scan(state.scans, interrupted, "interrupted", now_ms)
    resumed = 0
    if (pending := find_pending_deletion(state.scans, source_id)) and (ready := promote(state.scans, pending)):
        resumed = apply_deletions(state, ready, now_ms, keep)
        step()
    known = [r["source_id"] for r in state.source.where(F.col("source_id") == source_id).select("source_id").collect()]
    state.scans, scan = begin_scan(state.scans, source_id, scan_id, now_ms, count_bp=count_bp, missing_bp=missing_bp, sources=known)
    step()
    try:
        counts = ingest(state, scan, items, now_ms, keep)
        state.scans = _put(state.scans, replace(scan, unlistable_subtree_count=counts["unlistable"]))
        step()
        if review is not None and (said := review(_one(state.scans, scan_id), count_missing(state.document, scan))):
            state.scans = approve_scan(state.scans, scan_id, *said, now_ms)
    except Exception as error:
        state.scans = fail_scan(state.scans, scan_id, errors.kind_of(error), now_ms)
        step()
        raise
    verdict = finish_scan(state, scan_id, counts["enumerated"], counts["distinct"], now_ms, write_failures)
    told = None
    if verdict.excused:
        told = ("scan_approved_by_operator", {"reasons": ",".join(verdict.excused)})
    elif not verdict.passes:
        told = ("scan_aborted_safety", {"reasons": ",".join(verdict.reasons)})
    if told:
        import json

        row = state.document.sparkSession.createDataFrame([(0, 0, told[0], None, None, json.dumps(told[1]))], "enum_seq bigint, slot int, kind string, document_id string, version_id string, detail string")
        _append(state, row, scan_id, now_ms, keep)
    step()
    deleted = 0
    if ready := promote(state.scans, scan_id):
        deleted = apply_deletions(state, ready, now_ms, keep)
        step()
    return Report(_one(state.scans, scan_id), verdict, counts, deleted, resumed)


# --- status ------------------------------------------------------------------------------


def scan_status(status: Column, abort_reason: Column, approved_cap: Column, under_review: Column | None = None, busy: Column | None = None) -> Column:
    """How a scan shows: a running one under review, at work or interrupted; an aborted one whose deletions were declined (a cap of 0); else its status."""
    review = under_review if under_review is not None else F.lit(False)
    working = busy if busy is not None else F.lit(False)
    reasons = F.split(abort_reason, ",")
    soft = F.array_contains(reasons, "approval_missing_limit") & F.forall(reasons, lambda r: r.isin("count_ratio", "missing_ratio", "approval_missing_limit"))
    return (
        F.when((status == "running") & review, "review").when((status == "running") & working, "scanning").when(status == "running", "interrupted")
        .when((status == "aborted_safety") & (approved_cap == 0) & soft, "declined").otherwise(status)
    )


# --- many scans at once ------------------------------------------------------------------


def seen_intervals(seen: DataFrame) -> DataFrame:
    """``seen`` (scan_ord, document_id) as (seen_at, next_at, n): how many documents are seen at one scan and next at another (null: never)."""
    w = Window.partitionBy("document_id").orderBy("scan_ord")
    once = seen.select("document_id", "scan_ord").distinct()
    return once.select(F.col("scan_ord").alias("seen_at"), F.lead("scan_ord").over(w).alias("next_at")).groupBy("seen_at", "next_at").agg(F.count(F.lit(1)).alias("n"))


def chain_verdicts(seen: DataFrame, *, count_bp: int = COUNT_RATIO_BP, missing_bp: int = MISSING_RATIO_BP) -> list[dict[str, Any]]:
    """The valve's verdict on every scan of a source in turn, each on the state its predecessors left.

    A document is missing at scan k if it was seen at or after the last
    completed scan, and not again until after k: what wasn't seen by a completed
    scan is tombstoned by it. So the verdicts need the documents only as a table
    of intervals, whose size depends on the scans alone; that table comes to the
    driver, where the chain is followed.
    """
    rows = [(r["seen_at"], r["next_at"], r["n"]) for r in seen_intervals(seen).collect()]
    ords = sorted({r[0] for r in rows})
    out, base, previous = [], None, 0
    for k in ords:
        distinct = sum(n for p, _, n in rows if p == k)
        missing = sum(n for p, x, n in rows if p < k and (x is None or x > k) and (base is None or p >= base))
        scan = Scan(str(k), "", 0, k, count_bp, missing_bp, previous_distinct_count=previous)
        verdict = safety_valve(scan, distinct, missing)
        out.append({"scan_ord": k, "distinct_count": distinct, "missing": missing, "baseline": base, "status": "completed" if verdict.passes else "aborted_safety", "reasons": ",".join(verdict.reasons)})
        if verdict.passes:
            base, previous = k, distinct
    return out
