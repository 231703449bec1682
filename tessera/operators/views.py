"""Read-side views and searches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, py_fold, py_view_fold, view_fold
from .scan import COUNT_RATIO_BP, MISSING_RATIO_BP, Scan, scan_status

PAGE, CANDIDATES, ENTRIES, BLOCKS, FOLDERS, DISCOVERED = 50, 100, 100, 20, 100, 20

Tables = Mapping[str, DataFrame]


def state_counts(t: Tables) -> DataFrame:
    """One row: sources, active, versions, tombstoned."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    d = t["document"].agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "tombstoned").alias("tombstoned"))
    rows = count(t["source"], "sources").unionByName(count(t["document_version"], "versions")).unionByName(d.select(F.explode(F.create_map(F.lit("active"), "active", F.lit("tombstoned"), "tombstoned")).alias("what", "n")))
    return rows.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("sources", "active", "versions", "tombstoned")])


def source_overview(t: Tables) -> DataFrame:
    """Each source with its active documents, its latest scan by start, and the scan that is running."""
    active = t["document"].where("state = 'active'").groupBy("source_id").agg(F.count(F.lit(1)).alias("active_count"))
    last = t["scan_run"].groupBy("source_id").agg(
        F.max_by(F.struct("status", "abort_reason", "approved_max_missing_count"), "start_seq").alias("l"), F.max(F.when(F.col("status") == "running", F.col("scan_id"))).alias("running_id")
    )
    out = t["source"].select("source_id", "display_name").join(active, "source_id", "left").join(last, "source_id", "left")
    return out.select("source_id", "display_name", F.coalesce("active_count", F.lit(0)).alias("active_count"), F.col("l.status").alias("latest_status"), F.col("l.abort_reason").alias("latest_abort_reason"), "running_id")


def recent_scans(t: Tables, n: int = PAGE) -> DataFrame:
    return t["scan_run"].join(t["source"].select("source_id", "display_name"), "source_id").orderBy(F.desc("started_at"), F.desc("start_seq"), "scan_id").limit(n)


def search_documents(t: Tables, query: str, *, offset: int = 0, include_deleted: bool = False, page: int = PAGE) -> DataFrame:
    """A page of documents whose key holds the query; case is folded for A-Z alone."""
    key = ascii_lower("stable_key")
    rows = t["document"].where(_contains(key, query))
    if not include_deleted:
        rows = rows.where("state <> 'tombstoned'")
    v = t["document_version"].select(F.col("version_id").alias("active_version_id"), "size_bytes", "content_hash")
    top = rows.orderBy("stable_key", "document_id").offset(offset).limit(page)
    return top.join(t["source"].select("source_id", "display_name"), "source_id").join(v, "active_version_id", "left").select("document_id", "stable_key", "state", "display_name", "size_bytes", "content_hash")


def _contains(key: Column, query: str) -> Column:
    return key.contains(query.translate({c: c + 32 for c in range(65, 91)}))


def search_totals(t: Tables, query: str) -> DataFrame:
    """One row: total of all hits, and how many of them are deleted."""
    rows = t["document"].where(_contains(ascii_lower("stable_key"), query))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "tombstoned").alias("deleted"))


def document_versions(t: Tables, document_id: str, n: int = CANDIDATES) -> DataFrame:
    """The active version first, then the latest."""
    d = t["document"].where(F.col("document_id") == document_id).select("document_id", "active_version_id")
    rows = t["document_version"].where(F.col("document_id") == document_id).join(d, "document_id")
    return rows.orderBy(F.when(F.col("version_id") == F.col("active_version_id"), 0).otherwise(1), F.desc("ingested_at"), F.desc("version_id")).limit(n)


def scan_observations(t: Tables, scan_id: str, n: int = CANDIDATES) -> DataFrame:
    rows = t["observation"].where(F.col("scan_id") == scan_id).orderBy(F.desc("observation_seq")).limit(n)
    return rows.join(t["document"].select("document_id", "stable_key"), "document_id", "left")


def skipped_summary(t: Tables, scan_id: str | None = None) -> DataFrame:
    """How many entries were skipped, by kind, of one scan or of each."""
    rows = t["observation"].where("kind = 'entry_skipped'")
    if scan_id is not None:
        rows = rows.where(F.col("scan_id") == scan_id)
    return rows.groupBy("scan_id", F.coalesce(F.get_json_object("detail", "$.kind"), F.lit("unknown")).alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


# --- what an approval is about -----------------------------------------------------------


def missing_documents(t: Tables, scan_id: str, source_id: str) -> DataFrame:
    return t["document"].where((F.col("source_id") == source_id) & (F.col("state") == "active") & (F.col("last_seen_scan_id") != scan_id))


def candidate_hash(missing: DataFrame) -> DataFrame:
    """SHA-256 of all ids, in order, joined by line feeds.

    The text grows with the candidates of one source's scan (65 bytes each);
    a digest over it is what an operator's approval refers to.
    """
    ids = F.array_join(F.array_sort(F.collect_list("document_id")), "\n")
    return missing.agg(F.sha2(ids.cast("binary"), 256).alias("candidate_hash"), F.count(F.lit(1)).alias("candidates"))


def folder_histogram(missing: DataFrame, most: int = FOLDERS) -> DataFrame:
    """Candidates by top folder: the first ``most`` folders in order of ids, and the rest counted together under a null folder."""
    folder = F.when(F.col("stable_key").contains("/"), F.split_part("stable_key", F.lit("/"), F.lit(1))).otherwise("")
    g = missing.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first"))
    g = g.withColumn("place", F.row_number().over(Window.orderBy("first")))  # one row a folder
    return g.groupBy(F.when(F.col("place") <= most, F.col("folder")).alias("folder")).agg(F.sum("n").alias("n"))


def discovered_documents(t: Tables, scan_id: str, n: int = DISCOVERED) -> DataFrame:
    o = t["observation"].where((F.col("scan_id") == scan_id) & (F.col("kind") == "document_discovered")).select("document_id", "observation_seq")
    return o.join(t["document"].select("document_id", "stable_key"), "document_id").orderBy("stable_key", "observation_seq").limit(n)


def ratio_valve_would_fire(scan: Scan, distinct: int, missing: int) -> list[str]:
    """The preview with the fixed thresholds."""
    if scan.previous_distinct_count <= 0:
        return []
    out = []
    if distinct * 10_000 < scan.previous_distinct_count * COUNT_RATIO_BP:
        out.append("count_ratio")
    if missing * 10_000 > scan.previous_distinct_count * MISSING_RATIO_BP:
        out.append("missing_ratio")
    return out


def scan_statuses(t: Tables) -> DataFrame:
    return t["scan_run"].select("scan_id", "source_id", scan_status(F.col("status"), F.col("abort_reason"), F.col("approved_max_missing_count")).alias("shown"))


def attention_count(t: Tables) -> DataFrame:
    """Sources whose latest scan needs someone: interrupted, failed or stopped by the valve."""
    last = t["scan_run"].groupBy("source_id").agg(F.max_by(F.struct("status", "abort_reason", "approved_max_missing_count"), "start_seq").alias("l"))
    shown = scan_status(F.col("l.status"), F.col("l.abort_reason"), F.col("l.approved_max_missing_count"))
    return last.select(shown.alias("shown")).agg(F.count_if(F.col("shown").isin("interrupted", "failed", "aborted_safety")).alias("attention"))


def translated_reason(value: Column, names: Mapping[str, str]) -> Column:
    """Comma-joined reasons by their names, if every one has a name; else as they are."""
    parts = F.split(F.coalesce(value, F.lit("")), ",")
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(F.forall(parts, lambda p: F.map_contains_key(table, p)), F.array_join(F.transform(parts, lambda p: F.element_at(table, p)), " / ")).otherwise(F.coalesce(value, F.lit("")))


# --- contents ----------------------------------------------------------------------------


def filter_cells(cells: DataFrame, query: str, *, values_only: bool = False) -> DataFrame:
    """Cells (sheet, address, value, formula) that a query names by address, or whose value or formula holds it.

    A cell named by its address shows even if it is empty.
    """
    q = py_view_fold(query).strip()
    address = view_fold("address")
    named = (address == q) | (F.concat_ws("!", view_fold("sheet"), address) == q) if q else F.lit(False)
    filled = (F.col("value").isNotNull() & (F.col("value") != "")) | F.col("formula").isNotNull()
    holds = view_fold("value").contains(q) | view_fold("formula").contains(q)
    return cells.where(named | ((filled if values_only else F.lit(True)) & holds))


def filter_blocks(blocks: DataFrame, query: str) -> DataFrame:
    """Word blocks (index, kind, location, text, rows) with a hit; of a table only the cells that hit, the index as it was."""
    q = py_view_fold(query).strip()
    if not q:
        return blocks
    hit = (view_fold("text").contains(q) | view_fold("location").contains(q))
    paragraphs = blocks.where("kind = 'paragraph'").where(hit)
    cells = blocks.where("kind = 'table'").select("index", F.posexplode("rows").alias("r", "cells")).select("index", "r", F.posexplode("cells").alias("c", "cell"))
    cells = cells.where(view_fold("cell.text").contains(q) | view_fold("cell.location").contains(q))
    rows = cells.groupBy("index", "r").agg(F.array_sort(F.collect_list(F.struct("c", "cell"))).alias("cells"))
    rows = rows.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: F.transform(x["cells"], lambda y: y["cell"])).alias("hits"))
    tables = blocks.where("kind = 'table'").join(rows, "index").withColumn("rows", F.col("hits")).select(*blocks.columns)
    return paragraphs.unionByName(tables)


def normalized_entries(members: DataFrame, query: str = "", *, show_empty: bool = False) -> DataFrame:
    """Entries of normalised documents that show under a query.

    ``members``: group_index, unit_index, member_index, kind, place (a sheet
    cell's ``sheet!address`` or a location), value, formula, search_text,
    search_formula. ``place_fold`` and the search columns hold folded text.
    """
    q = py_fold(query)
    sheet = F.col("kind") == "sheet_cell"
    empty = F.coalesce(F.col("value") == "", F.lit(True))
    vacant = F.when(sheet, empty & F.col("formula").isNull()).otherwise(F.col("value") == "")
    rows = members.withColumn("vacant", vacant)
    if not show_empty:
        rows = rows.where(~F.col("vacant") | (F.col("place_fold") == q if q else F.lit(False)))
    if q:
        rows = rows.where(F.col("place_fold").contains(q) | F.col("search_text").contains(q) | F.coalesce("search_formula", F.lit("")).contains(q))
    return rows


def normalized_page(members: DataFrame, query: str = "", *, show_empty: bool = False, page: int = 0, size: int = ENTRIES) -> DataFrame:
    rows = normalized_entries(members, query, show_empty=show_empty)
    matched = rows.count()
    offset = max(0, min(page, max(0, matched - 1) // size)) * size
    return rows.orderBy("group_index", "unit_index", "member_index").offset(offset).limit(size)


def normalized_totals(members: DataFrame) -> DataFrame:
    e = normalized_entries(members, show_empty=True)
    return e.agg(F.count(F.lit(1)).alias("total"), F.count_if("vacant").alias("empty"))


def page_of(df: DataFrame, order: list[str], offset: int, size: int = BLOCKS) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)
