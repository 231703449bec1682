"""All queries of the engine by name, each with its DuckDB twin."""

from __future__ import annotations

from . import audits, lifecycle, lineage, packages

QUERIES = {**lineage.QUERIES, **packages.QUERIES, **lifecycle.QUERIES, **audits.QUERIES}
ORACLES = {**lineage.ORACLES, **packages.ORACLES, **lifecycle.ORACLES, **audits.ORACLES}
