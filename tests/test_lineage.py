"""Derivations, snapshots, views and the audit's rules on planted defects."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import errors, identity
from tessera.operators import audit, derive, snapshot, views
from tessera.operators.scan import Scan
from tessera.plans import lineage
from tessera.schemas import TABLES, broken_rows

RUNS = TABLES["processing_run"]


def runs(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], None, None, r[2], r[3], r[4], 0, 0, r[5], None, 60, None, None, r[6] if len(r) > 6 else False) for r in rows], RUNS)


def test_claims(spark):
    known = runs(
        spark, ("r1", "live", "leased", 1, "w", 5000), ("r2", "expired", "leased", 2, "w", 999), ("r3", "done", "succeeded", 1, "w", 1), ("r4", "final", "failed", 1, "w", 1, True),
        ("r5", "again", "failed", 3, "w", 1), ("r6", "again", "abandoned", 2, "w", 1),
    )
    keys = spark.createDataFrame([(k, "d", "v") for k in ("live", "expired", "done", "final", "again", "new", "new")] + [("rootless", "d", "x")], "derivation_key string, document_id string, root_version_id string")
    versions = spark.createDataFrame([("v",)], "version_id string")
    new, after = derive.claim(keys, known, versions, worker_id="me", lease_seconds=60, now_ms=1000)
    assert {r.derivation_key: (r.attempt, r.lease_expires_at) for r in new.collect()} == {"expired": (3, 61_000), "again": (4, 61_000), "new": (1, 61_000)}
    assert {r.status for r in after.where("run_id = 'r2'").collect()} == {"abandoned"}
    assert after.where("status = 'leased'").groupBy("derivation_key").count().where("count > 1").count() == 0


def test_leases(spark):
    known = runs(spark, ("a", "k", "leased", 1, "w", 5000), ("b", "k2", "leased", 1, "w", 1000), ("c", "k3", "succeeded", 1, "w", 9000))
    claims = spark.createDataFrame([("a", "w", "k"), ("a", "x", "k"), ("a", "x", "z"), ("b", "w", "k2"), ("c", "w", None), ("nope", "w", None)], "run_id string, claimed_by string, claimed_key string")
    got = [r.mismatch for r in derive.check_leases(claims, known, 1000).orderBy("run_id", "claimed_by", "claimed_key").collect()]
    assert got == [None, "other_worker", "key_mismatch", "lease_expired", "not_leased", "run_missing"]
    assert derive.stale_worker_observations(derive.check_leases(claims, known, 1000), "heartbeat").count() == 5
    assert [r.lease_expires_at for r in derive.heartbeat(known, "a", "w", 4000).orderBy("run_id").collect()] == [64_000, 1000, 9000]
    assert [r.status for r in derive.complete(known, "a", "w", "failed", 2000, permanent=True).orderBy("run_id").collect()] == ["failed", "leased", "succeeded"]
    assert [r.permanent for r in derive.complete(known, "a", "w", "failed", 2000, permanent=True).orderBy("run_id").collect()][0] is True
    assert [r.status for r in derive.complete(known, "b", "w", "succeeded", 2000).orderBy("run_id").collect()] == ["leased", "leased", "succeeded"]
    assert [r.status for r in derive.reap(known, 1000).orderBy("run_id").collect()] == ["leased", "abandoned", "succeeded"]


def drafts(spark, *rows):
    return spark.createDataFrame([(k, "d", "v", o, "chunk", c, None, None, None) for k, o, c in rows], "derivation_key string, document_id string, root_version_id string, ordinal bigint, type string, inline_content string, blob_key string, content_hash string, size_bytes bigint")


def test_commit_is_all_or_nothing(spark):
    none = spark.createDataFrame([], TABLES["derivation"]), spark.createDataFrame([], TABLES["artifact"])
    heads = spark.createDataFrame([("k", "d", "v")], "derivation_key string, document_id string, root_version_id string")
    d, a, bad = derive.commit(heads, drafts(spark, ("k", 0, "one"), ("k", 1, "é")), *none)
    assert (d.count(), a.count(), bad.count()) == (1, 2, 0)
    row = a.where("ordinal = 1").first()
    assert row.artifact_id == identity.py_artifact_id("k", 1) and row.size_bytes == 2
    again = derive.commit(heads, drafts(spark, ("k", 0, "one"), ("k", 1, "é")), d, a)
    assert (again[0].count(), again[1].count(), again[2].count()) == (1, 2, 0)
    other = derive.commit(heads, drafts(spark, ("k", 0, "two")), d, a)
    assert (other[0].count(), other[1].count()) == (1, 2)
    with pytest.raises(errors.DerivationDivergenceError):
        derive.assert_no_divergence(other[2])
    with pytest.raises(ValueError):
        derive.commit(heads, drafts(spark, ("k", 0, "a"), ("k", 2, "b")), *none)
    empty = derive.commit(heads, spark.createDataFrame([], drafts(spark, ("k", 0, "x")).schema), *none)
    assert empty[0].first().outputs_hash == "7d33c9d029ac7d770c5ede79a2ae0989c9df1bd8b8ce5784e61ad7a8f0317ebe"


def test_access_rules(spark):
    schema = "document_id string, tenant_id string, state string, principals array<string>, classification string, acl_hash string, last_error string"
    stored = spark.createDataFrame([("a", "t", "synced", ["x"], None, "h", 1, 1, None), ("b", "t", "unknown", [], None, "h", None, 1, "e")], TABLES["access_control"])
    new = spark.createDataFrame([("a", "t", "unknown", [], None, "n", "timeout"), ("b", "t", "synced", ["z", "y"], "c", "n", None), ("c", "t", "unknown", [], None, "n", "timeout")], schema)
    got = {r.document_id: r for r in derive.upsert_acl(stored, new, 9).collect()}
    assert (got["a"].state, got["a"].principals, got["a"].last_error, got["a"].synced_at) == ("synced", ["x"], "timeout", 1)
    assert (got["b"].state, got["b"].principals, got["b"].synced_at) == ("synced", ["y", "z"], 9)
    assert got["c"].state == "unknown" and got["c"].synced_at is None
    told = {r.document_id: (r.kind, json.loads(r.detail)) for r in derive.acl_observations(stored, new).collect()}
    assert told["a"] == ("acl_fetch_failed", {"tenantId": "t", "keptExistingSynced": True, "error": "timeout"}) and told["b"][0] == "acl_changed"
    assert told["c"] == ("acl_fetch_failed", {"tenantId": "t", "state": "unknown"})
    with pytest.raises(ValueError):
        derive.upsert_acl(stored, spark.createDataFrame([("a", "t", "unknown", ["x"], None, "n", None)], schema), 9)


def test_cursor_wraps(spark):
    v = spark.createDataFrame([("v1", "k", "h"), ("v2", "k", "h")], "version_id string, blob_key string, content_hash string")
    a = spark.createDataFrame([("a1", "k", "h"), ("a2", None, "h")], "artifact_id string, blob_key string, content_hash string")
    cursor = derive.BlobCursor()
    seen = [[r.ref_id for r in cursor.page(v, a, 2)] for _ in range(3)]
    assert seen == [["a1", "v1"], ["v2"], ["a1", "v1"]]


def test_trace(spark):
    a = spark.createDataFrame([("a", "k", "v"), ("b", "no", "v"), ("c", "k", "no")], "artifact_id string, derivation_key string, root_version_id string")
    d = spark.createDataFrame([("k", "p", "1")], "derivation_key string, processor_name string, processor_version string")
    v = spark.createDataFrame([("v", "doc")], "version_id string, document_id string")
    doc = spark.createDataFrame([("doc", "s", "key")], "document_id string, source_id string, stable_key string")
    assert {r.artifact_id: r.broken for r in derive.trace_to_origin(a, d, v, doc).collect()} == {"a": None, "b": "derivation", "c": "version"}
    with pytest.raises(Exception):
        derive.trace_to_origin(a, d, v, doc, strict=True).collect()


def test_snapshots(spark):
    make = lambda rows: {"document": spark.createDataFrame(rows, "document_id string, state string, last_seen_at bigint, flag boolean, bytes binary"), "observation": spark.createDataFrame([("k", "d"), ("k", None)], "kind string, document_id string")}
    a = make([("1", "x", 1, True, b"a"), ("2", None, 1, None, None)])
    assert snapshot.is_empty_diff(snapshot.diff_snapshots(a, make([("2", None, 9, None, None), ("1", "x", 2, True, b"a")])))
    b = make([("1", "y", 1, False, b"a"), ("3", "z", 1, True, b"")])
    b["observation"] = b["observation"].limit(1).unionByName(spark.createDataFrame([("new", None)], "kind string, document_id string"))
    got = sorted((r.table, r.key.replace("\0", "/"), r.change, r.column, r.before, r.after) for r in snapshot.diff_snapshots(a, b).collect())
    assert ("document", "1", "changed", "flag", "1", "0") in got and ("document", "1", "changed", "state", "x", "y") in got
    assert ("document", "2", "removed", None, None, None) in got and ("document", "3", "added", None, None, None) in got
    assert ("observation_kinds", "new/-", "added", None, None, None) in got
    with pytest.raises(AssertionError):
        snapshot.assert_same_state(a, b)
    with pytest.raises(ValueError):
        snapshot.assert_unique(snapshot.snapshot_state(make([("1", "x", 1, True, b""), ("1", "x", 1, True, b"")]))["document"], "document")


BASE = {
    "document": [("d", "s", "k", "active", "v", 1, 1, "scan", "f", 1, None)], "document_version": [("v", "d", "aa", 1, "aa", 1, "t", 1, 2, "scan", "v0.1")],
    "observation": [(1, "o1", "version_created", "d", "v", "scan", None, 1, "{}")],
}


def tables(spark, **rows):
    out = {n: spark.createDataFrame(rows.get(n, BASE.get(n, [])), ddl) for n, ddl in TABLES.items()}
    out["source"] = spark.createDataFrame([("s", "k", "c", "n", "NFC", True, "posix", True)], TABLES["source"])
    scan = "scan_id string, source_id string, status string, abort_reason string, write_failure_count bigint, completion_seq bigint, finished_at bigint"
    out["scan_run"] = spark.createDataFrame(rows.get("scan_run", [("scan", "s", "completed", None, 0, 1, 5)]), scan)
    return out


MUTATIONS = {
    "version_document_missing": {"document": []},
    "active_version_missing": {"document_version": []},
    "blob_verified_at_missing": {"document_version": [("v", "d", "aa", 1, "aa", 0, "t", 1, 2, "scan", "v")]},
    "blob_verified_after_ingest": {"document_version": [("v", "d", "aa", 1, "aa", 3, "t", 1, 2, "scan", "v")]},
    "blob_key_missing": {"document_version": [("v", "d", "aa", 1, "", 1, "t", 1, 2, "scan", "v")]},
    "duplicate_content_hash_for_document": {"document_version": [(x, "d", "aa", 1, "aa", 1, "t", 1, 2, "scan", "v") for x in ("v", "w")]},
    "active_pointer_does_not_match_latest_observation": {"observation": [(1, "o1", "version_created", "d", "v", "scan", None, 1, "{}"), (2, "o2", "version_created", "d", "w", "scan", None, 1, "{}")]},
    "versions_exist_but_no_active_pointer": {"document": [("d", "s", "k", "active", None, 1, 1, "scan", "f", 1, None)]},
    "tombstoned_without_observation": {"document": [("d", "s", "k", "tombstoned", "v", 1, 1, "scan", "f", 1, 5)]},
    "tombstone_without_scan": {"observation": [(1, "o", "document_tombstoned", "d", None, None, None, 1, "{}")]},
    "tombstone_from_non_promoted_scan": {"observation": [(1, "o", "document_tombstoned", "d", None, "scan", None, 1, "{}")], "scan_run": [("scan", "s", "failed", None, 0, None, 5)]},
    "tombstone_from_superseded_scan": {"observation": [(1, "o", "document_tombstoned", "d", None, "scan", None, 9, "{}")], "scan_run": [("scan", "s", "completed", None, 0, 1, 5), ("later", "s", "completed", None, 0, 2, 8)]},
    "aborted_scan_without_observation": {"scan_run": [("scan", "s", "aborted_safety", "x", 0, None, 5)]},
    "multiple_running_scans_for_source": {"scan_run": [(x, "s", "running", None, 0, None, None) for x in "ab"]},
    "stable_key_collides_after_normalization": {"document": [("d", "s", "K", "active", "v", 1, 1, "scan", "f", 1, None), ("e", "s", "k", "active", None, 1, 1, "scan", "f", 1, None)]},
    "broken_blob_reference_not_quarantined": {"observation": [(1, "o", "blob_reference_broken", "d", None, "scan", None, 1, "{}")]},
    "divergence_observed": {"observation": [(1, "o", "derivation_output_divergence", None, None, None, None, 1, "{}")]},
    "artifact_without_derivation": {"artifact": [("a", "k", 0, "d", "v", "chunk", "x", None, "h", 1, 1)]},
    "artifact_inline_hash_mismatch": {"artifact": [("a", "k", 0, "d", "v", "chunk", "x", None, "h", 1, 1)]},
    "artifact_count_mismatch": {"derivation": [("k", "p", "1", "c", "[]", "v", "d", 1, 2, "h")]},
    "input_ids_not_json": {"derivation": [("k", "p", "1", "c", "{", "v", "d", 1, 0, "h")]},
    "input_ids_not_a_string_array": {"derivation": [("k", "p", "1", "c", "[1]", "v", "d", 1, 0, "h")]},
    "input_ids_not_stored_in_key_order": {"derivation": [("k", "p", "1", "c", '["b","a"]', "v", "d", 1, 0, "h")]},
    "failed_acl_fetch_recorded_as_synced": {"access_control": [("d", "t", "synced", [], None, "h", 1, 1, "e")]},
}


@pytest.mark.parametrize("problem", list(MUTATIONS))
def test_each_defect_is_found(spark, problem):
    rule = getattr(audit, problem)
    assert rule(tables(spark)).count() == 0
    assert rule(tables(spark, **MUTATIONS[problem])).count() >= 1


def test_same_time_is_not_checked(spark):
    t = tables(spark, observation=[(1, "o", "document_tombstoned", "d", None, "scan", None, 8, "{}"), (2, "p", "version_created", "d", "v", "scan", None, 1, "{}")], scan_run=[("scan", "s", "completed", None, 0, 1, 5), ("later", "s", "completed", None, 0, 2, 8)])
    got = {r.name: r for r in audit.check_invariants(t, known_sources=["s"], vectors=[("a", "x", "x")], replay=(t, t))}
    assert got["DELETION_ONLY_FROM_COMPLETED_SCAN"].status == "not_checked"
    assert got["CANONICAL_KEY_STABILITY"].status == got["IDEMPOTENT_REPLAY"].status == got["NO_WORK_WITHOUT_CHANGE"].status == "ok"
    assert got["HASH_MATCHES_BLOB"].status == "not_checked"
    assert "ok" in audit.format_report(got.values())


def test_views(spark):
    cells = spark.createDataFrame([("S", "A1", "Ｘyz", None), ("S", "B2", None, "SUM(x)"), ("S", "C3", None, None), ("S", "D4", "", None)], "sheet string, address string, value string, formula string")
    show = lambda q, v=False: [r.address for r in views.filter_cells(cells, q, values_only=v).orderBy("address").collect()]
    assert show("x") == ["A1", "B2"] and show("c3", True) == ["C3"] and show("s!d4", True) == ["D4"] and show("", True) == ["A1", "B2"] and len(show("")) == 4
    blocks = spark.createDataFrame(
        [(0, "paragraph", "p1", "hello", None), (1, "table", "t1", None, [[("c1", "HELLO"), ("c2", "x")], [("c3", "y")]]), (2, "paragraph", "p2", "bye", None)],
        "index int, kind string, location string, text string, rows array<array<struct<location:string,text:string>>>",
    )
    got = {r["index"]: r["rows"] for r in views.filter_blocks(blocks, "hello").collect()}
    assert set(got) == {0, 1} and got[1] == [[("c1", "HELLO")]]
    assert views.ratio_valve_would_fire(Scan("a", "s", 0, 1, 0, 0, previous_distinct_count=1000), 899, 101) == ["count_ratio", "missing_ratio"]
    df = spark.createDataFrame([("a,b",), ("a,free text",), (None,)], "r string")
    assert [r[0] for r in df.select(views.translated_reason(F.col("r"), {"a": "A", "b": "B"})).collect()] == ["A / B", "a,free text", ""]


def test_row_rules(spark):
    assert set(broken_rows(tables(spark)).values()) == {0}
    bad = broken_rows(tables(spark, document=[("d", "s", "k", "tombstoned", "v", 1, 1, "scan", None, 1, None)]))
    assert sum(bad.values()) == 2


def by_query_and_sql(spark, folder, name, table, rows):
    """A query's rows and those of its SQL, over one table."""
    path = f"{folder}/{table}.parquet"
    rows.write.mode("overwrite").parquet(path)
    got = lineage.QUERIES[name](spark, str(folder))
    sql = lineage.ORACLES[name]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=repr), sorted(want, key=repr)


def test_cell_address_codec_beyond_a_sheet(spark, tmp_path):
    keys = [0, 1_048_574, 1_048_575, 1_048_576, 1_199_999, 9_999_999, 2_147_483_647, 3_000_000_000]
    lines = spark.createDataFrame([(k, s) for k in keys for s in (0, 1, 25, 26, 702, 16_383, 59_999)], "l_partkey bigint, l_suppkey bigint")
    got, want = by_query_and_sql(spark, tmp_path, "cell_address_codec", "lineitem", lines)
    assert got == want and len(got) == 56 and all(r[2] and r[3:] == r[:2] for r in got)


def test_sheet_filter_beyond_a_sheet(spark, tmp_path):
    keys = [0, 1_048_574, 1_048_575, 1_048_576, 1_048_577, 1_199_999, 9_999_999, 2_147_483_647, 3_000_000_000]
    parts = spark.createDataFrame([(k, f"Part{k}", f"Brand#{k % 25}", kind, size) for k in keys for kind, size in (("ECONOMY STEEL", 1), ("Castle", 29), ("TIN", 50))], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    got, want = by_query_and_sql(spark, tmp_path, "sheet_filter", "part", parts)
    assert got == want and got and all(r[2].lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == str(r[0] + 1) for r in got)
