"""Queries over Word and Excel files that are made from the driver's tables, and a few more of storage and views, each with its SQL.

The test tables hold no Office files, so small packages are written from rows
here; what the parser and the normaliser read back must be the rows again.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import derive, normalize, views
from ..sources import blobs, folder, office
from .standin import Tables, with_tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, *tables: str):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return put


# --- writing packages --------------------------------------------------------------------


def _package(main: str, form: str, parts: dict[str, str], relations: list[tuple[str, str, str]]) -> bytes:
    rel = lambda rows: f'<Relationships xmlns="{office.REL}">' + "".join(f'<Relationship Id="{i}" Type="{office.OFFICE_REL}/{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"
    place, _, name = main.rpartition("/")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{office.CONTENT_TYPES}"><Override PartName="/{main}" ContentType="{office.MAIN_TYPES[form]}"/></Types>')
        z.writestr("_rels/.rels", rel([("main", "officeDocument", main)]))
        z.writestr(f"{place}/_rels/{name}.rels", rel(relations))
        for part, body in parts.items():
            z.writestr(part, body)
    return out.getvalue()


def write_word(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return _package("word/document.xml", "docx", {"word/document.xml": f'<w:document xmlns:w="{office.WORD}"><w:body>{body}</w:body></w:document>'}, [])


def write_sheet(name: str, values: list[str]) -> bytes:
    """One sheet with one column of inline strings."""
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c></row>' for k, v in enumerate(values, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{office.SHEET}" xmlns:r="{office.OFFICE_REL}"><sheets><sheet name="{escape(name)}" r:id="s1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{office.SHEET}"><sheetData>{rows}</sheetData></worksheet>',
    }
    return _package("xl/workbook.xml", "xlsx", parts, [("s1", "worksheet", "worksheets/sheet1.xml")])


def word_file(paragraphs: Column) -> Column:
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([write_word(r or []) for r in rows.to_pylist()], pa.binary())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(paragraphs)


def sheet_file(name: Column, values: Column) -> Column:
    def run(names: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([write_sheet(n, r or []) for n, r in zip(names.to_pylist(), rows.to_pylist())], pa.binary())

    run.__annotations__ = {"names": pa.Array, "rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(name, values)


def _word(t: Tables) -> DataFrame:
    files = t.raw("benchmark").select("item_id", word_file(F.split("text", "\n")).alias("file"))
    return files.select("item_id", office.parsed_column(F.col("file"), F.lit("docx")).alias("r")).select("item_id", "r.content")


def _sheets(t: Tables) -> DataFrame:
    """A workbook a conversation, a row a turn."""
    turns = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    files = turns.select("conv_id", sheet_file(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.transform("x", lambda v: v["text"])).alias("file"))
    return files.select("conv_id", office.parsed_column(F.col("file"), F.lit("xlsx")).alias("r")).select("conv_id", "r.content")


# --- Office ------------------------------------------------------------------------------


@query("SELECT item_id, (unnest(range(0, len(p))))::INT AS index, unnest(p) AS text, '本文 / 段落 ' || (unnest(range(1, len(p) + 1)))::VARCHAR AS location FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark)")
def word_blocks(t: Tables) -> DataFrame:
    return office.blocks_of(_word(t), "item_id").select("item_id", "index", "text", "location")


@query("SELECT conv_id, 'A' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR AS address, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS row_no, text AS value, 'inlineStr' AS kind, 'General' AS format FROM conversations")
def sheet_cells(t: Tables) -> DataFrame:
    cells = office.cells_of(_sheets(t), "conv_id")
    return cells.select("conv_id", "address", F.col("row").alias("row_no"), "value", F.col("valueType").alias("kind"), F.col("numberFormat").alias("format"))


@query(r"""SELECT conv_id, 'c' || conv_id::VARCHAR || '!A' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR AS place,
  lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))) AS search_text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS unit_index FROM conversations""")
def normalized_members(t: Tables) -> DataFrame:
    parsed = _sheets(t)
    made = parsed.select("conv_id", normalize.normalized_column(F.col("content")).alias("n")).select("conv_id", "n.content")
    return normalize.members_of(made, "conv_id").select("conv_id", "place", "search_text", "unit_index")


@query("SELECT item_id, 'failed' AS status, 'invalid_document' AS error FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT item_id, 'unsupported', NULL FROM benchmark WHERE item_id % 2 = 0")
def parse_failures(t: Tables) -> DataFrame:
    """Broken and unsupported files are results of their rows."""
    form = F.when(F.col("item_id") % 2 == 1, "docx").otherwise("pdf")
    r = t.raw("benchmark").select("item_id", office.parsed_column(F.col("text").cast("binary"), form).alias("r"))
    return r.select("item_id", "r.status", "r.error")


# --- storage -----------------------------------------------------------------------------


@query("""WITH b AS (SELECT sha256(text) AS blob_key, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 7 AND doc_id = (SELECT min(o.doc_id) FROM documents o WHERE o.text = documents.text))
SELECT d.doc_id, coalesce(sha256(b.content) = sha256(d.text), false) AS verified FROM documents d LEFT JOIN b ON b.blob_key = sha256(d.text)""")
def blob_verify(t: Tables) -> DataFrame:
    """Stored bytes against references, where some blobs are torn and some are gone."""
    d = t.raw("documents").select("doc_id", "text", identity.content_hash("text").alias("blob_key"))
    first = d.groupBy("blob_key").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")).where("doc_id % 10 <> 7")
    stored = first.select("blob_key", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    refs = d.select("doc_id", "blob_key", F.col("blob_key").alias("content_hash"))
    return blobs.verify_references(refs, stored).select("doc_id", "verified")


@query("""SELECT event_id, floor(value * 1000)::BIGINT::VARCHAR || ':' || user_id::VARCHAR AS print, CASE WHEN event_id % 5 = 1 THEN 'separator_or_nul' WHEN event_id % 5 = 2 THEN 'reserved_character' END AS refused FROM events""")
def entry_names(t: Tables) -> DataFrame:
    name = F.when(F.col("event_id") % 5 == 1, "a\\b").when(F.col("event_id") % 5 == 2, "c:d").otherwise("plain")
    return t.raw("events").select("event_id", folder.fingerprint_column(F.col("value") * 1000, F.col("user_id")).alias("print"), folder.rejection_column(name, True).alias("refused"))


# --- more views and leases ---------------------------------------------------------------


@query("""SELECT o.observation_seq, o.kind, d.stable_key FROM (SELECT * FROM observation WHERE scan_id = 'scan-src3-4' ORDER BY observation_seq DESC LIMIT 100) o LEFT JOIN document d ON d.document_id = o.document_id""", "observation", "document")
def scan_observations(t: Tables) -> DataFrame:
    return views.scan_observations(t, "scan-src3-4").select("observation_seq", "kind", "stable_key")


@query("""SELECT d.document_id, d.stable_key, o.observation_seq FROM observation o JOIN document d ON d.document_id = o.document_id WHERE o.scan_id = 'scan-src3-4' AND o.kind = 'document_discovered' ORDER BY d.stable_key, o.observation_seq LIMIT 20""", "observation", "document")
def discovered_documents(t: Tables) -> DataFrame:
    return views.discovered_documents(t, "scan-src3-4").select("document_id", "stable_key", "observation_seq")


@query("""SELECT item_id, (i - 1)::INT AS index, text FROM (SELECT item_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark)) WHERE contains(lower(text), 'thin')""")
def word_filter(t: Tables) -> DataFrame:
    blocks = office.blocks_of(_word(t), "item_id").withColumn("id", F.col("item_id"))
    return views.filter_blocks(blocks, "THIN").select("item_id", "index", "text")


_NOW = 893980800000


@query(f"""SELECT run_id, CASE WHEN run_id = (SELECT min(run_id) FROM processing_run WHERE status = 'leased' AND lease_expires_at > {_NOW}) THEN {_NOW} + lease_seconds * 1000 ELSE lease_expires_at END AS lease_expires_at FROM processing_run""", "processing_run")
def lease_heartbeat(t: Tables) -> DataFrame:
    runs = t["processing_run"]
    first = runs.where(derive.live(_NOW)).agg(F.min_by(F.struct("run_id", "worker_id"), "run_id").alias("r")).first()["r"]
    return derive.heartbeat(runs, first["run_id"], first["worker_id"], _NOW).select("run_id", "lease_expires_at") if first else runs.select("run_id", "lease_expires_at")


@query("""SELECT conv_id::VARCHAR AS derivation_key, turn AS ordinal, sha256('art:' || strlen(conv_id::VARCHAR)::VARCHAR || ':' || conv_id::VARCHAR || strlen(turn::VARCHAR)::VARCHAR || ':' || turn::VARCHAR) AS artifact_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes
  FROM conversations WHERE conv_id % 4 <> 0""")
def committed_artifacts(t: Tables) -> DataFrame:
    """What a commit adds: the artifacts of keys that aren't stored, none of a key that is."""
    c = t.raw("conversations")
    none = F.lit(None).cast("string")
    drafts = c.select(
        F.col("conv_id").cast("string").alias("derivation_key"), F.lit("d").alias("document_id"), F.lit("v").alias("root_version_id"), F.col("turn").alias("ordinal"), F.lit("chunk").alias("type"),
        F.col("text").alias("inline_content"), none.alias("blob_key"), none.alias("content_hash"), F.lit(None).cast("bigint").alias("size_bytes"),
    )
    heads = drafts.select("derivation_key", "document_id", "root_version_id").distinct()
    stored = derive.outputs_of(derive.draft_artifacts(drafts.where("derivation_key % 4 = 0"))).drop("contiguous")
    _, artifacts, _ = derive.commit(heads, drafts, stored, derive.draft_artifacts(drafts).where("false"))
    return artifacts.select("derivation_key", "ordinal", "artifact_id", "content_hash", "size_bytes")


@query("""SELECT processor_name, count(*) AS derivations, sum(artifact_count)::BIGINT AS artifacts FROM derivation GROUP BY processor_name""", "derivation")
def processors(t: Tables) -> DataFrame:
    return derive.known_processors(t["derivation"]).groupBy("processor_name").agg(F.sum("derivations").alias("derivations"), F.sum("artifacts").cast("bigint").alias("artifacts"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40""")
def block_page(t: Tables) -> DataFrame:
    page = views.page_of(t.raw("documents").select("doc_id"), ["doc_id"], 40)
    return page.withColumn("place", (F.row_number().over(Window.orderBy("doc_id")) + 39).cast("bigint"))  # a page of 20 rows


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(k) ELSE k END AS k FROM (SELECT c_custkey, trim('/' || c_mktsegment || '/' || c_name || '/', '/') AS k FROM customer)""")
def source_policy_keys(t: Tables) -> DataFrame:
    """Keys by the policy of each row's own source."""
    raw = F.concat(F.lit("\\"), "c_mktsegment", F.lit("\\"), "c_name", F.lit("/"))
    return t.raw("customer").select("c_custkey", text.normalize_key(raw, F.lit("NFC"), F.col("c_custkey") % 3 == 0, F.lit("posix"), F.lit(True)).alias("k"))
