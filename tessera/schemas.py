"""The stored tables as DDL. Times are whole milliseconds, ids lowercase hex, ratios whole basis points."""

from __future__ import annotations

from .operators.scan import OBSERVATION_SCHEMA

TABLES = {
    "source": "source_id string, kind string, config_hash string, display_name string, key_unicode_form string, key_case_fold boolean, key_path_separator string, key_trim_slashes boolean",
    "document": "document_id string, source_id string, stable_key string, state string, active_version_id string, first_seen_at bigint, last_seen_at bigint, last_seen_scan_id string, last_fingerprint string, last_fingerprint_at bigint, tombstoned_at bigint",
    "document_version": "version_id string, document_id string, content_hash string, size_bytes bigint, blob_key string, blob_verified_at bigint, mime_type string, source_modified_at bigint, ingested_at bigint, discovered_by_scan_id string, pipeline_version string",
    "access_control": "document_id string, tenant_id string, state string, principals array<string>, classification string, acl_hash string, synced_at bigint, last_attempt_at bigint, last_error string",
    "derivation": "derivation_key string, processor_name string, processor_version string, config_hash string, input_ids string, root_version_id string, document_id string, created_at bigint, artifact_count bigint, outputs_hash string",
    "artifact": "artifact_id string, derivation_key string, ordinal bigint, document_id string, root_version_id string, type string, inline_content string, blob_key string, content_hash string, size_bytes bigint, created_at bigint",
    "processing_run": "run_id string, derivation_key string, document_id string, root_version_id string, status string, attempt bigint, worker_id string, started_at bigint, heartbeat_at bigint, lease_expires_at bigint, finished_at bigint, lease_seconds int, error_kind string, error_message string, permanent boolean",
    "observation": OBSERVATION_SCHEMA,
    "rename_candidate": "disappeared_document_id string, appeared_document_id string, content_hash string, observed_at bigint, resolution string",
}

#: Row rules that a database would hold as constraints: table and a condition that no row may meet.
FORBIDDEN = {
    "document": ["(state = 'tombstoned') <> (tombstoned_at IS NOT NULL)", "(last_fingerprint IS NULL) <> (last_fingerprint_at IS NULL)", "state NOT IN ('active', 'tombstoned', 'quarantined')"],
    "access_control": ["state = 'synced' AND synced_at IS NULL", "state = 'unknown' AND size(principals) > 0"],
    "artifact": ["(inline_content IS NULL) = (blob_key IS NULL)", "ordinal < 0"],
    "processing_run": ["status = 'leased' AND (worker_id IS NULL OR lease_expires_at IS NULL OR lease_seconds IS NULL)"],
    "document_version": ["size_bytes < 0"],
}


def broken_rows(tables) -> dict[str, int]:
    """How many rows break each rule."""
    return {f"{name}: {rule}": tables[name].where(rule).count() for name, rules in FORBIDDEN.items() if name in tables for rule in rules}
