import hashlib
from dataclasses import replace

import pytest

from tessera.functions import errors
from tessera.operators import audit, scan as S
from tessera.schemas import TABLES

ITEMS = "source_id string, enum_seq bigint, kind string, stable_key string, subtree_key string, error_kind string, reason string, link_count bigint, quick_fingerprint string, mime_type string, modified_at bigint, outcome struct<kind:string,content_hash:string,size_bytes:bigint,error_kind:string,declared_size_bytes:bigint,actual_size_bytes:bigint>"


def content(text):
    return ("content", hashlib.sha256(text.encode()).hexdigest(), len(text), None, None, None)


class World:
    def __init__(self, spark, fold=False):
        self.spark = spark
        make = lambda n: spark.createDataFrame([], TABLES[n])
        source = spark.createDataFrame([("s", "local-fs", "c", "s", "NFC", fold, "posix", True)], TABLES["source"])
        self.state = S.State(source, make("document"), make("document_version"), make("observation"), make("rename_candidate"))
        self.n = 0

    def items(self, rows):
        """(kind, key, outcome or text or None, fingerprint)."""
        out = []
        for k, (kind, key, what, fp) in enumerate(rows):
            outcome = content(what) if isinstance(what, str) else what
            sub = key if kind == "unlistable_subtree" else None
            out.append(("s", k, kind, None if sub else key, sub, "EACCES" if sub else None, None, None, fp, None, None, outcome))
        return self.spark.createDataFrame(out, ITEMS)

    def scan(self, rows, **kw):
        self.n += 1
        return S.run_scan(self.state, "s", self.items(rows), scan_id=f"scan{self.n}", now_ms=1_700_000_000_000 + self.n, keep=lambda d: d.checkpoint(), **kw)

    def kinds(self, scan_id):
        return [r["kind"] for r in self.state.observation.where(f"scan_id = '{scan_id}'").orderBy("observation_seq").collect()]

    def documents(self):
        return {r["stable_key"]: r for r in self.state.document.collect()}


def files(n, **changed):
    return [("entry", f"f{i}", changed.get(f"f{i}", f"contents of f{i}"), f"m{i}") for i in range(n)]


def test_unchanged_rescan_writes_nothing(spark):
    w = World(spark)
    w.scan(files(5))
    before = w.state.document_version.count(), w.state.observation.count()
    report = w.scan(files(5))
    assert (w.state.document_version.count(), w.state.observation.count()) == before
    assert report.counts["versions_created"] == 0 and report.scan.status == "completed"
    seqs = [r[0] for r in w.state.observation.select("observation_seq").orderBy("observation_seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1))


def test_change_revert_and_fingerprint_collision(spark):
    w = World(spark)
    w.scan(files(3))
    w.scan(files(3, f1="other"))
    assert w.kinds("scan2") == ["fingerprint_collision", "version_created"]
    w.scan(files(3))
    assert w.kinds("scan3") == ["fingerprint_collision", "version_reverted"]
    assert w.state.document_version.count() == 4


def test_tombstone_and_revival_rechecks_renames(spark):
    w = World(spark)
    w.scan(files(20))
    gone = w.documents()["f19"]["document_id"]
    w.state.rename_candidate = spark.createDataFrame([(gone, "x", "h", 1, "confirmed_rename"), ("y", "z", "h", 1, "confirmed_rename")], TABLES["rename_candidate"])
    assert w.scan(files(19)).deleted == 1
    assert w.kinds("scan2") == ["document_missing", "document_tombstoned"]
    w.scan(files(20))
    assert w.kinds("scan3") == ["document_revived", "rename_needs_recheck"]
    assert w.documents()["f19"]["state"] == "active" and w.documents()["f19"]["tombstoned_at"] is None
    assert {r["disappeared_document_id"]: r["resolution"] for r in w.state.rename_candidate.collect()} == {gone: "needs_recheck", "y": "confirmed_rename"}


def test_unreadable_is_not_missing(spark):
    w = World(spark)
    w.scan(files(20))
    bad = [("entry", "f0", ("unreadable", None, None, "EIO", None, None), None), ("entry", "f1", ("size_mismatch", None, None, None, 100, 40), "z")]
    report = w.scan(files(20)[2:] + bad)
    assert report.deleted == 0 and report.counts["not_read"] == 2
    assert set(w.kinds("scan2")) == {"document_unreadable", "size_mismatch_rejected"}
    assert w.documents()["f1"]["last_fingerprint"] == "z"


def test_valve_stops_and_writes_nothing(spark):
    w = World(spark)
    w.scan(files(20))
    report = w.scan(files(10))
    assert report.scan.status == "aborted_safety" and report.scan.abort_reason == "count_ratio,missing_ratio" and report.deleted == 0
    assert w.kinds("scan2") == ["scan_aborted_safety"]
    assert all(d["state"] == "active" for d in w.documents().values())
    approved = w.scan(files(10), review=lambda scan, missing: ("looked at", missing))
    assert approved.scan.status == "completed" and approved.deleted == 10 and approved.scan.count_ratio_threshold_bp == 9000
    assert w.kinds("scan3")[0] == "scan_approved_by_operator"
    assert w.scan(files(3), review=lambda scan, missing: ("no", 0)).scan.abort_reason == "approval_missing_limit,count_ratio,missing_ratio"


def test_unlistable_and_write_failures_block_deletion(spark):
    w = World(spark)
    w.scan(files(20))
    report = w.scan(files(19) + [("unlistable_subtree", "sub", None, None)])
    assert report.scan.abort_reason == "unlistable_subtree" and "subtree_unlistable" in w.kinds("scan2")
    assert w.scan(files(19), write_failures=1).scan.abort_reason == "write_failures"


def test_skipped_entries_keep_their_documents(spark):
    w = World(spark)
    w.scan(files(20))
    report = w.scan(files(18) + [("hard_linked", "f18", None, None), ("vanished_during_scan", "f19", None, None), ("office_temporary_file", "~$x", None, None), ("unusable_name", "bad", None, None)])
    assert report.deleted == 0 and report.scan.status == "completed"
    assert w.kinds("scan2").count("entry_skipped") == 4 and w.kinds("scan2").count("document_unreadable") == 2


def test_keys_that_meet(spark):
    w = World(spark, fold=True)
    report = w.scan([("entry", "A.txt", "one", "1"), ("entry", "a.txt", "two", "2"), ("entry", "A.txt", "one", "3")])
    assert report.counts["distinct"] == 1 and report.counts["collisions"] == 2
    assert w.kinds("scan1") == ["document_discovered", "version_created", "stable_key_collision", "version_created", "stable_key_collision", "version_reverted"]
    cafe = World(spark)
    assert cafe.scan([("entry", "café", "x", None), ("entry", "café", "x", None)]).counts["distinct"] == 1


def test_empty_content_is_content(spark):
    w = World(spark)
    w.scan([("entry", "e", "", "1")])
    assert w.state.document_version.first()["content_hash"].startswith("e3b0c442")


def test_control_rows():
    scans, a = S.begin_scan((), "s", "a", 1, sources=["s"])
    with pytest.raises(errors.ConcurrentScanError):
        S.begin_scan(scans, "s", "b", 2, sources=["s"])
    with pytest.raises(errors.NotFoundError):
        S.begin_scan((), "x", "b", 2, sources=["s"])
    with pytest.raises(ValueError):
        S.begin_scan((), "s", "b", 2, sources=["s"], count_bp=10_001)
    failed = S.fail_scan(scans, "a", "crash", 3)
    with pytest.raises(errors.ScanNotRunningError):
        S.fail_scan(failed, "a", "again", 4)
    with pytest.raises(ValueError):
        S.approve_scan(scans, "a", " ", 1, 2)
    again = S.approve_scan(scans, "a", "note", 1, 2)
    with pytest.raises(ValueError):
        S.approve_scan(again, "a", "note", 1, 2)
    done = tuple(replace(s, status="completed", finished_at=2, completion_seq=1, deletion_state="pending", distinct_count=7) for s in scans)
    assert S.find_pending_deletion(done, "s") == "a" and S.promote(done, "a")
    more, b = S.begin_scan(done, "s", "b", 3, sources=["s"])
    assert b.previous_distinct_count == 7 and b.start_seq == 2
    later = tuple(replace(s, status="completed", finished_at=4, completion_seq=2, deletion_state="pending") if s.scan_id == "b" else s for s in more)
    with pytest.raises(errors.StaleScanError):
        S.gate_for_deletion(later, "a")
    assert [s.deletion_state for s in S.mark_deletion_applied(later, S.promote(later, "b"))] == ["superseded", "applied"]
    assert S.find_running_scan(more, "s").scan_id == "b"


@pytest.mark.parametrize("distinct,missing,reasons", [(900, 0, ()), (899, 0, ("count_ratio",)), (1000, 100, ()), (1000, 101, ("missing_ratio",)), (1, 999, ("count_ratio", "missing_ratio"))])
def test_valve_boundaries(distinct, missing, reasons):
    scan = S.Scan("a", "s", 0, 2, 9000, 1000, previous_distinct_count=1000)
    assert S.safety_valve(scan, distinct, missing).reasons == reasons
    assert S.safety_valve(replace(scan, previous_distinct_count=0), distinct, missing).passes


def test_chain_equals_scans_one_after_another(spark):
    import random

    rng = random.Random(5)
    seen = [(k, f"d{d}") for k in range(1, 9) for d in range(40) if rng.random() < (0.6 if k % 3 == 0 else 0.97)]
    chain = S.chain_verdicts(spark.createDataFrame(seen, "scan_ord bigint, document_id string"))
    w = World(spark)
    for row in chain:
        report = w.scan([("entry", d, d, None) for k, d in seen if k == row["scan_ord"]])
        assert (report.scan.status, report.scan.abort_reason or "", report.scan.distinct_count) == (row["status"], row["reasons"], row["distinct_count"])


def test_audits_hold_after_scans(spark):
    w = World(spark)
    w.scan(files(20))
    w.scan(files(19, f3="new"))
    t = {n: spark.createDataFrame([], ddl) for n, ddl in TABLES.items()} | {n: getattr(w.state, n) for n in ("source", "document", "document_version", "observation")}
    columns = [f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in vars(S.Scan("a", "s", 0, 0, 0, 0, abort_reason="", deletion_state="", previous_completed_scan_id="", approved_note="")).items()]
    t["scan_run"] = spark.createDataFrame([tuple(vars(s).values()) for s in w.state.scans], ", ".join(columns))
    results = audit.check_invariants(t)
    assert [r.name for r in results if r.status == "violated"] == []
    audit.assert_invariants(results, ["LINEAGE_COMPLETE", "POINTER_MATCHES_OBSERVATION", "DELETION_ONLY_FROM_COMPLETED_SCAN"])
    t["document"] = t["document"].limit(0)
    broken = {r.name: r for r in audit.check_invariants(t)}
    assert {f["problem"] for f in broken["LINEAGE_COMPLETE"].findings} == {"version_document_missing"}
    with pytest.raises(AssertionError):
        audit.assert_invariants(broken.values(), [])
