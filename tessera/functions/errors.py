"""Errors of the store, each with a stable code."""

from __future__ import annotations


class StoreError(Exception):
    """Base; ``code`` names the kind, ``facts`` what is known about the case."""

    code = "store_error"

    def __init__(self, message: str = "", **facts: object):
        super().__init__(message or self.code)
        self.facts = facts


def _kind(name: str, code: str, doc: str) -> type[StoreError]:
    return type(name, (StoreError,), {"code": code, "__doc__": doc, "__module__": __name__})


ConcurrentScanError = _kind("ConcurrentScanError", "concurrent_scan", "A source has a running scan already.")
ScanNotRunningError = _kind("ScanNotRunningError", "scan_not_running", "The scan has ended.")
StaleScanError = _kind("StaleScanError", "stale_scan", "A later scan has completed, or this one may not delete.")
NotFoundError = _kind("NotFoundError", "not_found", "What was asked for isn't there.")
SizeMismatchError = _kind("SizeMismatchError", "size_mismatch", "Bytes read differ from the declared number.")
BlobDivergenceError = _kind("BlobDivergenceError", "blob_divergence", "Other bytes stand under a content address.")
DerivationDivergenceError = _kind("DerivationDivergenceError", "derivation_divergence", "One derivation key, different outputs.")
StaleWorkerError = _kind("StaleWorkerError", "stale_worker", "The worker holds no live lease.")
ManifestConflictError = _kind("ManifestConflictError", "manifest_conflict", "Another writer published first.")


def is_store_error(error: BaseException, code: str | None = None) -> bool:
    return isinstance(error, StoreError) and (code is None or error.code == code)


def kind_of(error: BaseException) -> str:
    """A store error's code, else the error's own code, else its class name."""
    if isinstance(error, StoreError):
        return error.code
    own = getattr(error, "code", None)
    return own if isinstance(own, str) and own else type(error).__name__ or "unknown"
