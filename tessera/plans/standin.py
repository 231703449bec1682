"""Lineage tables made from the driver's tables, with planted defects.

The reference's tables have no counterpart among the test tables, so each is
derived here, by SQL that Spark and DuckDB both run: sources, scans, documents,
versions, observations, derivations, artifacts, runs, access rules and rename
candidates. Every rule of the audit finds something in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialect import Duck, Spark, field, text

INPUTS = {
    "source": ("documents",), "doc": ("documents",), "scan_run": ("events",), "document": ("documents",), "document_version": ("documents",),
    "observation": ("events", "documents"), "derivation": ("conversations", "documents"), "artifact": ("conversations", "documents"),
    "processing_run": ("orders",), "access_control": ("labels", "documents"), "rename_candidate": ("documents",),
}


def _doc(d) -> str:
    """One row a document: identity, key, content hash, first version."""
    # some keys of a source differ from that of its document 20 ids before in case alone
    number = "(CASE WHEN doc_id % 120 < 40 THEN doc_id - doc_id % 40 + doc_id % 20 ELSE doc_id END)"
    key = f"concat('F', {text(f'{number} % 7')}, '/', CASE WHEN doc_id % 40 < 20 THEN 'Doc' ELSE 'doc' END, {text(number)}, '.txt')"
    return f"""
      SELECT *, {d.sha(f"concat('ver:', {field(d, 'document_id')}, {field(d, 'content_hash')})")} AS v1 FROM (
        SELECT doc_id, text, source, stable_key, n_chars, {d.sha(f"concat('doc:', {field(d, 'source')}, {field(d, 'stable_key')})")} AS document_id,
               {d.sha('text')} AS content_hash
        FROM (SELECT doc_id, coalesce(text, '') AS text, source, n_chars, {key} AS stable_key FROM {d.t('documents')}) AS k) AS h"""


def _derivation(d) -> str:
    """One row a conversation, with the facts that derivation and artifacts share."""
    key = d.sha(f"concat('der:', {field(d, 'name')}, {field(d, 'version')}, {field(d, 'config')}, '1:', {field(d, 'root')})")
    return f"""
      SELECT *, CASE WHEN conv_id % 11 = 5 THEN concat('bad-', {text('conv_id')}) ELSE {key} END AS derivation_key FROM (
        SELECT c.conv_id, 'chunk' AS name, '1' AS version, {d.sha("'{}'")} AS config,
               CASE WHEN c.conv_id % 7 = 3 THEN {d.sha(f"concat('lost', {text('c.conv_id')})")} ELSE doc.v1 END AS root, doc.document_id
        FROM (SELECT DISTINCT conv_id FROM {d.t('conversations')}) AS c JOIN ({_doc(d)}) AS doc ON doc.doc_id = c.conv_id) AS m"""


def _artifact(d) -> str:
    return f"""
      SELECT concat('art-', {text('t.conv_id')}, '-', {text('t.turn')}) AS artifact_id, k.derivation_key, k.root,
             CASE WHEN t.conv_id % 19 = 4 THEN t.turn + 1 ELSE t.turn END AS ordinal,
             CASE WHEN t.conv_id % 17 = 6 THEN concat('other-', {text('t.conv_id')}) ELSE k.document_id END AS document_id,
             CASE WHEN t.conv_id % 29 = 8 THEN {d.sha("'elsewhere'")} ELSE k.root END AS root_version_id, 'chunk' AS type,
             CASE WHEN t.conv_id % 6 = 1 THEN CAST(NULL AS varchar(10)) ELSE t.text END AS inline_content,
             CASE WHEN t.conv_id % 6 = 1 THEN {d.sha('t.text')} ELSE CAST(NULL AS varchar(10)) END AS blob_key,
             CASE WHEN t.conv_id % 21 = 2 AND t.turn = 0 THEN {d.sha("'wrong'")} ELSE {d.sha('t.text')} END AS content_hash,
             {d.bytes('t.text')} + CASE WHEN t.conv_id % 23 = 9 AND t.turn = 1 THEN 1 ELSE 0 END AS size_bytes, t.conv_id, t.turn
      FROM {d.t('conversations')} AS t JOIN ({_derivation(d)}) AS k ON k.conv_id = t.conv_id"""


def definitions(d) -> dict[str, str]:
    doc, drv, art = _doc(d), _derivation(d), _artifact(d)
    scan_of = lambda s, day: f"concat('scan-', {s}, '-', {text(day)})"
    base = 1_700_000_000_000
    out = {"doc": doc}
    out["source"] = f"""
      SELECT source AS source_id, 'local-fs' AS kind, {d.sha("concat('cfg:', source)")} AS config_hash, source AS display_name, 'NFC' AS key_unicode_form,
             source IN ('src0', 'src2', 'src4', 'src6', 'src8', 'src10', 'src12', 'src14', 'src16', 'src18') AS key_case_fold, 'posix' AS key_path_separator, true AS key_trim_slashes
      FROM {d.t('documents')} GROUP BY source"""
    out["scan_run"] = f"""
      SELECT {scan_of('source_id', 'day')} AS scan_id, source_id, started_at, day AS start_seq, CASE WHEN status = 'running' THEN NULL ELSE finished_at END AS finished_at, status,
             enumerated_count, distinct_count, CASE WHEN day % 11 = 0 THEN 1 ELSE 0 END AS write_failure_count, CASE WHEN day % 13 = 0 THEN 1 ELSE 0 END AS unlistable_subtree_count,
             CASE WHEN status = 'completed' THEN day END AS completion_seq,
             CASE WHEN status = 'completed' THEN CASE WHEN day % 4 = 0 THEN 'pending' ELSE 'applied' END END AS deletion_state,
             CASE WHEN status = 'aborted_safety' THEN CASE WHEN day % 3 = 0 THEN 'approval_missing_limit,missing_ratio' WHEN day % 2 = 0 THEN 'count_ratio,missing_ratio' ELSE 'missing_ratio' END END AS abort_reason,
             CASE WHEN status = 'aborted_safety' AND day % 3 = 0 THEN 0 END AS approved_max_missing_count
      FROM (SELECT *, CASE WHEN day >= 29 THEN 'running' WHEN (day + shift) % 5 = 0 THEN 'aborted_safety' WHEN (day + shift) % 5 = 1 THEN 'failed' ELSE 'completed' END AS status
            FROM (SELECT concat('src', {text('user_id % 20')}) AS source_id, user_id % 20 AS shift, {d.day('ts')} AS day, min({d.ms('ts')}) AS started_at,
                         max({d.ms('ts')}) AS finished_at, count(*) AS enumerated_count, count(DISTINCT user_id) AS distinct_count
                  FROM {d.t('events')} GROUP BY user_id % 20, {d.day('ts')}) AS g) AS s"""
    out["document"] = f"""
      SELECT document_id, source AS source_id, stable_key, CASE WHEN doc_id % 10 = 0 THEN 'tombstoned' WHEN doc_id % 10 = 1 THEN 'quarantined' ELSE 'active' END AS state,
             CASE WHEN doc_id % 17 = 3 THEN NULL WHEN doc_id % 23 = 5 THEN {d.sha(f"concat('missing', {text('doc_id')})")} ELSE v1 END AS active_version_id,
             {base} + doc_id AS first_seen_at, {base} + 2 * doc_id AS last_seen_at, {scan_of('source', 'doc_id % 28 + 1')} AS last_seen_scan_id,
             concat({text('doc_id')}, ':', {text('n_chars')}) AS last_fingerprint, {base} + 2 * doc_id AS last_fingerprint_at,
             CASE WHEN doc_id % 10 = 0 THEN {base} + 3 * doc_id END AS tombstoned_at
      FROM ({doc}) AS x"""
    out["document_version"] = f"""
      SELECT CASE WHEN doc_id % 59 = 2 THEN concat(v1, '') ELSE v1 END AS version_id, CASE WHEN doc_id % 53 = 1 THEN concat('ghost-', {text('doc_id')}) WHEN doc_id % 61 = 1 THEN {d.sha("'other document'")} ELSE document_id END AS document_id,
             content_hash, {d.bytes('text')} AS size_bytes, CASE WHEN doc_id % 31 = 4 THEN '' WHEN doc_id % 37 = 6 THEN NULL ELSE content_hash END AS blob_key,
             CASE WHEN doc_id % 41 = 7 THEN 0 WHEN doc_id % 43 = 9 THEN {base} + doc_id + 60000 ELSE {base} + doc_id END AS blob_verified_at, 'text/plain' AS mime_type,
             {base} + doc_id + 5 AS ingested_at, {scan_of('source', 'doc_id % 28 + 1')} AS discovered_by_scan_id, 'v0.1' AS pipeline_version, text AS content
      FROM ({doc}) AS x
      UNION ALL
      SELECT {d.sha("concat('second', v1)")}, document_id, CASE WHEN doc_id % 47 = 5 THEN content_hash ELSE {d.sha("concat(text, '#2')")} END, {d.bytes('text')} + 2,
             {d.sha("concat(text, '#2')")}, {base} + doc_id, 'text/plain', {base} + doc_id + 9, {scan_of('source', 'doc_id % 28 + 1')}, 'v0.1', concat(text, '#2')
      FROM ({doc}) AS y WHERE doc_id % 5 = 0 OR doc_id % 47 = 5"""
    out["observation"] = f"""
      SELECT e.event_id AS observation_seq, concat('obs-', {text('e.event_id')}) AS observation_id,
             CASE e.event_id % 9 WHEN 0 THEN 'version_created' WHEN 1 THEN 'version_reverted' WHEN 2 THEN 'document_tombstoned' WHEN 3 THEN 'document_discovered'
               WHEN 4 THEN 'entry_skipped' WHEN 5 THEN 'blob_reference_broken' WHEN 6 THEN 'scan_aborted_safety' WHEN 7 THEN 'derivation_output_divergence' ELSE 'document_revived' END AS kind,
             CASE WHEN e.event_id % 83 = 7 THEN NULL ELSE x.document_id END AS document_id,
             CASE WHEN e.event_id % 9 IN (0, 1) THEN CASE WHEN e.event_id % 4 = 3 THEN {d.sha("concat('second', x.v1)")} ELSE x.v1 END END AS version_id,
             CASE WHEN e.event_id % 97 = 2 THEN NULL ELSE {scan_of(f"concat('src', {text('e.user_id % 20')})", f"CASE WHEN e.event_id % 27 = 2 AND {d.day('e.ts')} > 6 THEN {d.day('e.ts')} - 5 ELSE {d.day('e.ts')} END")} END AS scan_id,
             {d.ms('e.ts')} AS occurred_at, concat('{{"kind":"', CASE e.event_id % 3 WHEN 0 THEN 'hard_linked' WHEN 1 THEN 'unusable_name' ELSE 'vanished_during_scan' END, '"}}') AS detail
      FROM {d.t('events')} AS e LEFT JOIN ({doc}) AS x ON x.doc_id = e.user_id"""
    out["artifact"] = f"SELECT artifact_id, derivation_key, ordinal, document_id, root_version_id, type, inline_content, blob_key, content_hash, size_bytes, {base} + conv_id AS created_at FROM ({art}) AS x"
    joined = d.joined("concat(a.artifact_id, ':', a.content_hash)", "a.ordinal")
    out["derivation"] = f"""
      SELECT k.derivation_key, k.name AS processor_name, k.version AS processor_version, k.config AS config_hash,
             CASE WHEN k.conv_id % 31 = 6 THEN 'not json' WHEN k.conv_id % 31 = 7 THEN '[1]' WHEN k.conv_id % 31 = 9 THEN concat('["z","', k.root, '"]') ELSE concat('["', k.root, '"]') END AS input_ids,
             k.root AS root_version_id, k.document_id, {base} + k.conv_id AS created_at, n.n + CASE WHEN k.conv_id % 13 = 2 THEN 1 ELSE 0 END AS artifact_count,
             CASE WHEN k.conv_id % 9 = 4 THEN {d.sha("'stale'")} ELSE n.outputs_hash END AS outputs_hash
      FROM ({drv}) AS k JOIN (SELECT a.conv_id, count(*) AS n, {d.sha(f"concat('out:', {joined})")} AS outputs_hash FROM ({art}) AS a GROUP BY a.conv_id) AS n ON n.conv_id = k.conv_id
      WHERE k.conv_id % 25 <> 24"""
    out["processing_run"] = f"""
      SELECT concat('run-', {text('o_orderkey')}) AS run_id, concat('key-', {text('o_custkey % 600')}) AS derivation_key,
             CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'leased' END AS status, o_orderkey % 5 + 1 AS attempt, concat('w', {text('o_orderkey % 3')}) AS worker_id,
             {d.ms('o_orderdate')} AS started_at, {d.ms('o_orderdate')} + 120000 AS lease_expires_at, 120 AS lease_seconds,
             CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 2 = 0 ELSE false END AS permanent
      FROM {d.t('orders')}"""
    out["access_control"] = f"""
      SELECT x.document_id, CASE WHEN l.doc_id % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id, CASE WHEN l.quality = 1 THEN 'synced' ELSE 'unknown' END AS state,
             CASE WHEN l.quality = 1 AND l.doc_id % 3 <> 0 THEN '["u1"]' ELSE '[]' END AS principals, {d.sha(f"concat('acl', {text('l.doc_id % 5')})")} AS acl_hash,
             CASE WHEN l.quality = 1 THEN {base} + l.doc_id END AS synced_at, CASE WHEN l.toxic = 1 THEN 'timeout' END AS last_error
      FROM {d.t('labels')} AS l JOIN ({doc}) AS x ON x.doc_id = l.doc_id"""
    out["rename_candidate"] = f"""
      SELECT a.document_id AS disappeared_document_id, b.document_id AS appeared_document_id, a.content_hash,
             CASE a.doc_id % 3 WHEN 0 THEN 'confirmed_rename' WHEN 1 THEN 'unresolved' ELSE 'rejected' END AS resolution
      FROM (SELECT content_hash, min(doc_id) AS lo, max(doc_id) AS hi FROM ({doc}) AS g GROUP BY content_hash HAVING count(*) > 1) AS p
      JOIN ({doc}) AS a ON a.doc_id = p.lo JOIN ({doc}) AS b ON b.doc_id = p.hi"""
    return out


_SPARK, _DUCK = definitions(Spark()), definitions(Duck())


class Tables:
    """The stand-in tables of a folder as DataFrames, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        for table in INPUTS[name]:
            self.raw(table).createOrReplaceTempView(Spark.prefix + table)
        return self.spark.sql(_SPARK[name])


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL over the stand-in tables ``names``; ``sql`` may begin with a WITH of its own."""
    own = sql.lstrip()
    more = ", " + own[len("WITH ") :] if own.startswith("WITH ") else "\n" + own
    return "WITH " + ", ".join(f"{n} AS ({_DUCK[n]})" for n in names) + more
