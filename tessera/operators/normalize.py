"""Normalised documents: parsed documents regrouped into rows of members with folded search text."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_config_hash
from ..functions.text import py_coordinates, py_fold
from ..sources.office import to_json

NORMALIZER_NAME, NORMALIZER_VERSION = "office-normalize", "normalize-1"
# The normaliser's configuration, whose hash is part of its derivations' keys.
NORMALIZER_CONFIG = {"schemaVersion": 1, "rules": "members-v1", "search": "nfkc-space-lower-v1", "dates": "raw"}
MOST_BYTES, MOST_MEMBERS, MOST_SHEETS, MOST_MERGES, MOST_ROWS, MOST_BLOCKS = 16 << 20, 20_000, 2_000, 20_000, 20_000, 20_000


class NormalizeError(ValueError):
    pass


def config_hash() -> str:
    return canonical_config_hash(NORMALIZER_CONFIG)


# --- the schema of parsed documents ------------------------------------------------------


def _is(value: Any, kind: type, what: str) -> Any:
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise NormalizeError(f"{what} is malformed")
    return value


def _count(value: Any) -> int:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if _is(value, int, "a position") < 1:
        raise NormalizeError("a position is malformed")
    return value


def _text_or_null(value: Any) -> str | None:
    return None if value is None else _is(value, str, "a text")


def _fields(value: Any, spec: dict[str, Any]) -> dict[str, Any]:
    """The members of an object that ``spec`` names, in its order, each checked by its rule."""
    _is(value, dict, "an entry")
    return {k: rule(value.get(k)) for k, rule in spec.items()}


def _text(v: Any) -> str:
    return _is(v, str, "a text")


def _flag(v: Any) -> bool:
    return _is(v, bool, "a flag")


_PARAGRAPH = {"kind": _text, "location": _text, "text": _text, "style": _text}
_CELL = {"location": _text, "text": _text, "columnSpan": _count, "verticalMerge": _text}
_SHEET_CELL = {
    "address": _text, "row": _count, "column": _count, "value": _text_or_null, "valueType": _text, "formula": _text_or_null, "formulaKind": _text, "numberFormat": _text,
    "hiddenRow": _flag, "hiddenColumn": lambda v: None if v is None else _flag(v),
}


def checked(value: Any) -> dict[str, Any]:
    """A parsed document of version 1 with exactly its known members, or an error."""
    root = _is(value, dict, "the result")
    if root.get("schemaVersion") != 1 or isinstance(root.get("schemaVersion"), bool):
        raise NormalizeError("an unknown version of results")
    warnings = [_text(w) for w in _is(root.get("warnings"), list, "warnings")]
    if root.get("format") == "docx":
        blocks = []
        for b in _is(root.get("blocks"), list, "blocks"):
            if _is(b, dict, "a block").get("kind") == "paragraph":
                blocks.append(_fields(b, _PARAGRAPH))
            elif b.get("kind") == "table":
                rows = [[_fields(c, _CELL) for c in _is(r, list, "a row")] for r in _is(b.get("rows"), list, "rows")]
                blocks.append({"kind": "table", "location": _text(b.get("location")), "rows": rows})
            else:
                raise NormalizeError("an unknown kind of block")
        return {"schemaVersion": 1, "format": "docx", "warnings": warnings, "blocks": blocks}
    if root.get("format") != "xlsx" or root.get("dateSystem") not in ("1900", "1904"):
        raise NormalizeError("an unknown format")
    sheets = []
    for s in _is(root.get("sheets"), list, "sheets"):
        _is(s, dict, "a sheet")
        sheets.append({
            "name": _text(s.get("name")), "state": _text(s.get("state")), "part": _text(s.get("part")),
            "cells": [_fields(c, _SHEET_CELL) for c in _is(s.get("cells"), list, "cells")], "merges": [_text(m) for m in _is(s.get("merges"), list, "merges")],
        })
    return {"schemaVersion": 1, "format": "xlsx", "warnings": warnings, "dateSystem": root["dateSystem"], "sheets": sheets}


# --- normalisation -----------------------------------------------------------------------


class _Places:
    """Names that may stand once."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def take(self, name: str) -> None:
        if not name or name in self.seen:
            raise NormalizeError(f"a repeated or empty position: {name}")
        self.seen.add(name)


def preflight(doc: dict[str, Any]) -> None:
    """Refuses what can't fit before anything is copied: a lower bound of the output's size by its structure alone."""
    size = len(to_json({"schemaVersion": 1, "format": doc["format"], "dateSystem": doc.get("dateSystem"), "warnings": doc["warnings"], "groups": []}).encode())
    groups = doc["blocks"] if doc["format"] == "docx" else doc["sheets"]
    if len(groups) > (MOST_BLOCKS if doc["format"] == "docx" else MOST_SHEETS):
        raise NormalizeError("too many groups")
    for g in groups:
        if doc["format"] == "xlsx":
            if len(g["merges"]) > MOST_MERGES:
                raise NormalizeError("too many merged ranges")
            size += len(to_json({"kind": "sheet", **{k: g[k] for k in ("name", "part", "state", "merges")}, "units": []}).encode())
        else:
            size += len(to_json({"kind": g["kind"], "location": g["location"], "units": []}).encode())
            rows = len(g["rows"]) if g["kind"] == "table" else 1
            if rows > MOST_ROWS:
                raise NormalizeError("too many rows")
            size += rows * len('{"row":1,"members":[]}')
        if size > MOST_BYTES:
            raise NormalizeError("the structure alone exceeds the output limit")


def normalize(parsed: Any) -> dict[str, Any]:
    """Sheets by row and column, tables by row, paragraphs alone; every member keeps its source as it is stored."""
    doc = checked(parsed)
    preflight(doc)
    groups, members = [], 0
    places, parts, names = _Places(), _Places(), _Places()
    if doc["format"] == "docx":
        for b in doc["blocks"]:
            places.take(b["location"])
            if b["kind"] == "paragraph":
                units = [{"row": None, "members": [{"kind": "word_paragraph", "source": b, "searchText": py_fold(b["text"])}]}]
            else:
                units = []
                for r, row in enumerate(b["rows"], 1):
                    for c in row:
                        places.take(c["location"])
                    units.append({"row": r, "members": [{"kind": "word_cell", "source": c, "searchText": py_fold(c["text"])} for c in row]})
            members += sum(len(u["members"]) for u in units)
            groups.append({"kind": b["kind"], "location": b["location"], "units": units})
    else:
        for s in doc["sheets"]:
            parts.take(s["part"])
            names.take(s["name"])
            addresses, rows = _Places(), {}
            for c in sorted(s["cells"], key=lambda c: (c["row"], c["column"])):
                addresses.take(c["address"])
                try:
                    at = py_coordinates(c["address"])
                except ValueError as error:
                    raise NormalizeError(str(error)) from None
                if at != (c["row"], c["column"]):
                    raise NormalizeError(f"an address disagrees with its row and column: {c['address']}")
                member = {"kind": "sheet_cell", "source": c, "searchText": py_fold(c["value"] or ""), "searchFormula": py_fold(c["formula"] or "")}
                rows.setdefault(c["row"], []).append(member)
            for m in s["merges"]:
                ends = m.split(":")
                try:
                    (r1, c1), (r2, c2) = map(py_coordinates, ends)
                except ValueError:
                    raise NormalizeError(f"a malformed merged range: {m}") from None
                if r1 > r2 or c1 > c2:
                    raise NormalizeError(f"a reversed merged range: {m}")
            members += len(s["cells"])
            groups.append({"kind": "sheet", "name": s["name"], "part": s["part"], "state": s["state"], "merges": s["merges"], "units": [{"row": r, "members": ms} for r, ms in rows.items()]})
    if members > MOST_MEMBERS:
        raise NormalizeError("too many members")
    out = {"schemaVersion": 1, "format": doc["format"], "dateSystem": doc.get("dateSystem"), "warnings": doc["warnings"], "groups": groups}
    if len(to_json(out).encode()) > MOST_BYTES:
        raise NormalizeError("the result exceeds the output limit")
    return out


def verify(content: str, parsed: Any) -> bool:
    """Whether a stored result is, byte for byte, what its parent gives."""
    return len(content.encode()) <= MOST_BYTES and content == to_json(normalize(parsed))


RESULT = "struct<content:string,error:string>"


def normalized_column(content: Column) -> Column:
    """The normalised JSON of parsed JSON, or an error's message."""

    def run(contents: pa.Array) -> pa.Array:
        rows = []
        for text in contents.to_pylist():
            try:
                rows.append({"content": None if text is None else to_json(normalize(json.loads(text))), "error": None})
            except ValueError as error:
                rows.append({"content": None, "error": str(error)})
        return pa.array(rows, pa.struct([("content", pa.string()), ("error", pa.string())]))

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(content)


_SOURCE = (
    "struct<kind:string,location:string,text:string,style:string,columnSpan:int,verticalMerge:string,address:string,row:int,column:int,value:string,valueType:string,formula:string,"
    "formulaKind:string,numberFormat:string,hiddenRow:boolean,hiddenColumn:boolean>"
)
NORMALIZED_SCHEMA = (
    "schemaVersion int, format string, dateSystem string, warnings array<string>, groups array<struct<kind:string,location:string,name:string,part:string,state:string,merges:array<string>,"
    f"units:array<struct<row:int,members:array<struct<kind:string,source:{_SOURCE},searchText:string,searchFormula:string>>>>>>"
)


def members_of(normalized: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row a member, as ``views.normalized_entries`` wants them."""
    g = normalized.select(key, F.from_json(content, NORMALIZED_SCHEMA).alias("n")).select(key, F.posexplode("n.groups").alias("group_index", "g"))
    u = g.select(key, "group_index", F.col("g.name").alias("name"), F.posexplode("g.units").alias("unit_index", "u"))
    m = u.select(key, "group_index", "unit_index", "name", F.posexplode("u.members").alias("member_index", "m"))
    sheet = F.col("m.kind") == "sheet_cell"
    place = F.when(sheet, F.concat_ws("!", "name", "m.source.address")).otherwise(F.col("m.source.location"))
    from ..functions.text import search_fold

    return m.select(
        key, "group_index", "unit_index", "member_index", F.col("m.kind").alias("kind"), place.alias("place"), search_fold(place).alias("place_fold"),
        F.when(sheet, F.col("m.source.value")).otherwise(F.col("m.source.text")).alias("value"), F.col("m.source.formula").alias("formula"),
        F.col("m.searchText").alias("search_text"), F.col("m.searchFormula").alias("search_formula"),
    )


def check_commit(heads: DataFrame, artifacts: DataFrame, t: dict[str, DataFrame]) -> None:
    """Refuses derivations (with counts) and artifacts that ``normalization_findings`` would find fault with, before they are stored."""
    parents = heads.select(F.explode(F.from_json("input_ids", "array<string>")).alias("artifact_id")).distinct()
    keys = t["artifact"].join(parents, "artifact_id", "left_semi").select("derivation_key").distinct()
    near = lambda name: t[name].join(keys, "derivation_key", "left_semi")
    checked = {
        "artifact": near("artifact").unionByName(artifacts, allowMissingColumns=True), "derivation": near("derivation").unionByName(heads, allowMissingColumns=True), "processing_run": near("processing_run"),
    }
    bad = normalization_findings(checked).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].subject} can't be stored as normalised: {bad[0].detail}")


def normalization_findings(t: dict[str, DataFrame]) -> DataFrame:
    """Findings (subject, detail) of normalised artifacts whose shape, parent, or contents don't add up.

    The shape and the evidence of the parent are joins; the contents are
    recomputed from the parent's, a pair of artifacts at a time.
    """
    a = t["artifact"].select("artifact_id", "derivation_key", "type", "ordinal", "blob_key", "inline_content", "content_hash", "size_bytes", "root_version_id", "document_id")
    d = t["derivation"].select("derivation_key", "processor_name", "config_hash", "input_ids", "artifact_count")
    rows = d.join(a, "derivation_key", "left").where((F.col("processor_name") == NORMALIZER_NAME) | (F.col("type") == "normalized_document"))
    shape = (
        (F.col("processor_name") == NORMALIZER_NAME) & (F.col("type") == "normalized_document") & (F.col("ordinal") == 0) & (F.col("artifact_count") == 1)
        & F.col("blob_key").isNull() & (F.col("config_hash") == config_hash())
    )
    rows = rows.withColumn("shape", F.coalesce(shape, F.lit(False))).withColumn("inputs", F.from_json("input_ids", "array<string>"))
    rows = rows.withColumn("parent", F.when(F.size("inputs") == 1, F.col("inputs")[0]))
    n = t["artifact"].groupBy("derivation_key").agg(F.count(F.lit(1)).alias("outputs"))
    won = t["processing_run"].where("status = 'succeeded'").groupBy("derivation_key").agg(F.count(F.lit(1)).alias("won"))
    p = a.where("type = 'parsed_document' AND ordinal = 0 AND blob_key IS NULL").join(d.where("processor_name = 'office-xml' AND artifact_count = 1").select("derivation_key"), "derivation_key", "left_semi")
    p = p.join(n.where("outputs = 1").select("derivation_key"), "derivation_key", "left_semi").join(won.where("won > 0").select("derivation_key"), "derivation_key", "left_semi")
    p = p.where((F.sha2(F.col("inline_content").cast("binary"), 256) == F.col("content_hash")) & (F.octet_length("inline_content") == F.col("size_bytes")))
    p = p.select(F.col("artifact_id").alias("parent"), F.col("inline_content").alias("parent_content"), F.col("root_version_id").alias("p_root"), F.col("document_id").alias("p_doc"))
    j = rows.join(p, "parent", "left")
    again = normalized_column(F.col("parent_content"))["content"]
    fine = F.col("shape") & F.coalesce((F.col("p_root") == F.col("root_version_id")) & (F.col("p_doc") == F.col("document_id")), F.lit(False))
    j = j.withColumn("again", again)
    why = F.when(~F.col("shape"), "shape").when(~fine, "parent").when(~F.col("again").eqNullSafe(F.col("inline_content")), "correspondence")
    return j.withColumn("why", why).where("why IS NOT NULL").select(F.coalesce("artifact_id", "derivation_key").alias("subject"), F.col("why").alias("detail"))
