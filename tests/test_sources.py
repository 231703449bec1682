"""Folders, Office files, blobs, the manifest store, the engine over them, and streams."""

import io
import itertools
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import errors
from tessera.operators import audit, normalize
from tessera.plans.manifest import Store, schema_status, table_digest, upgrade
from tessera.schemas import TABLES
from tessera.sources import blobs, folder, office as o
from tessera.streaming import observations as stream


# --- Office files ------------------------------------------------------------------------


def pack(parts, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*items):
    return f'<Relationships xmlns="{o.REL}">' + "".join(f'<Relationship Id="{i}" Type="{o.OFFICE_REL}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


def types(path, form):
    return f'<Types xmlns="{o.CONTENT_TYPES}"><Override PartName="/{path}" ContentType="{o.MAIN_TYPES[form]}"/></Types>'


def docx(body, extra="", more=None):
    document = f'<?xml version="1.0"?><w:document xmlns:w="{o.WORD}" xmlns:mc="{o.COMPAT}" {extra}><w:body>{body}</w:body></w:document>'
    styles = f'<w:styles xmlns:w="{o.WORD}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    parts = {
        "[Content_Types].xml": types("word/document.xml", "docx"), "_rels/.rels": rels(("r", "officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml")),
        "word/document.xml": document, "word/styles.xml": styles,
    }
    return pack(parts | (more or {}))


def xlsx(sheet, strings="", formats='<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="30"/>', book=""):
    parts = {
        "[Content_Types].xml": types("xl/workbook.xml", "xlsx"), "_rels/.rels": rels(("r", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": rels(("s1", "worksheet", "worksheets/sheet1.xml"), ("a", "sharedStrings", "ss.xml"), ("b", "styles", "st.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{o.SHEET}" xmlns:r="{o.OFFICE_REL}">{book}<sheets><sheet name="A" r:id="s1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{o.SHEET}">{sheet}</worksheet>', "xl/ss.xml": f'<sst xmlns="{o.SHEET}">{strings}</sst>',
        "xl/st.xml": f'<styleSheet xmlns="{o.SHEET}"><cellXfs>{formats}</cellXfs></styleSheet>',
    }
    return pack(parts)


def text(body):
    return [b.get("text") for b in o.parse_office(docx(body), "docx")["blocks"]]


def run(t):
    return f"<w:r><w:t>{t}</w:t></w:r>"


def test_word_text():
    assert text(f"<w:p>{run('a')}<w:ins>{run('b')}</w:ins><w:del>{run('c')}</w:del><w:moveFrom>{run('d')}</w:moveFrom></w:p>") == ["ab"]
    assert text('<w:p><w:r><w:t xml:space="preserve"> a </w:t><w:tab/><w:br/><w:noBreakHyphen/></w:r></w:p>') == [" a \t\n‑"]
    assert text("<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr></w:p>") == [""]
    assert text(f"<w:sdt><w:sdtContent><w:p>{run('in')}</w:p></w:sdtContent></w:sdt>") == ["in"]
    ruby = o.parse_office(docx(f"<w:p><w:ruby><w:rt>{run('yomi')}</w:rt><w:rubyBase>{run('base')}</w:rubyBase></w:ruby></w:p>"), "docx")
    assert ruby["blocks"][0]["text"] == "base（yomi）" and o.W_RUBY in ruby["warnings"]
    sym = o.parse_office(docx('<w:p><w:r><w:rPr><w:rFonts w:ascii="Wing"/></w:rPr><w:t></w:t><w:sym w:char="F0A7"/></w:r></w:p>'), "docx")
    assert sym["blocks"][0]["text"] == o.N_SYMBOL.format("Wing", "F0FC") + o.N_SYMBOL.format("Wing", "F0A7") and sym["warnings"].count(o.W_SYMBOL) == 1


def test_word_tables_and_wrappers():
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p>{run(t)}</w:p></w:tc>"
    row = f"<w:tr>{cell('1', '<w:gridSpan w:val=\"3\"/><w:vMerge/>')}<w:sdt><w:sdtContent>{cell('2')}</w:sdtContent></w:sdt></w:tr>"
    nested = f"<w:tc><w:tbl><w:tr>{cell('deep')}</w:tr></w:tbl><w:p>{run('own')}</w:p></w:tc>"
    parsed = o.parse_office(docx(f"<w:p/><w:tbl>{row}<w:customXml><w:tr>{nested}</w:tr></w:customXml></w:tbl>"), "docx")
    table = parsed["blocks"][1]
    assert [[(c["text"], c["columnSpan"], c["verticalMerge"]) for c in r] for r in table["rows"]] == [[("1", 3, "continue"), ("2", 1, "")], [("deep\nown", 1, "")]]
    assert table["rows"][1][0]["location"] == "本文 / 表 1 / 行 2 / セル 1" and o.W_NESTED.format("本文 / 表 1") in parsed["warnings"]


def test_workbook_values():
    cells = '<row r="1" hidden="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>46284</v></c><c r="C1" s="2"><v>1</v></c></row><row r="3"><c r="A3"><f t="shared">_xlfn.X(1)</f></c><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3" t="b"><v>1</v></c></row>'
    parsed = o.parse_office(xlsx(f'<cols><col min="2" max="2" hidden="1"/></cols><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells>', "<si><r><t>ri</t></r><r><t>ch_x0041_</t></r><rPh><t>no</t></rPh></si>", book='<workbookPr date1904="1"/>'), "xlsx")
    sheet = parsed["sheets"][0]
    got = {c["address"]: (c["value"], c["valueType"], c["numberFormat"], c["hiddenRow"], c["hiddenColumn"]) for c in sheet["cells"]}
    assert got["A1"] == ("richA", "s", "General", True, False) and got["B1"] == ("46284", "n", "mm-dd-yy", True, True)
    assert got["C1"][2].startswith("組み込み書式 30") and got["B3"][0] == "in" and parsed["dateSystem"] == "1904" and sheet["merges"] == ["A1:B1"]
    assert o.W_SERIAL.format("A", "B1、C1", "", "1904") in parsed["warnings"] and o.W_NO_RESULT.format("A") in parsed["warnings"]
    assert o.excel_string("a_x0041__xD83D__xDE00_") == "aA😀"


BROKEN = {
    "not a package": b"junk", "empty": b"", "dtd": docx("", more={"word/document.xml": f'<!DOCTYPE x><w:document xmlns:w="{o.WORD}"><w:body/></w:document>'}),
    "xml 1.1": docx("", more={"word/document.xml": f'<?xml version="1.1"?><w:document xmlns:w="{o.WORD}"><w:body/></w:document>'}), "unknown element": docx('<x:y xmlns:x="urn:unknown"/>'),
    "strict": docx("", more={"word/document.xml": '<w:document xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"><w:body/></w:document>'}), "deep": docx("<w:p>" * 80 + "</w:p>" * 80),
    "span": docx('<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="0"/></w:tcPr></w:tc></w:tr></w:tbl>'), "outside": docx("", more={"word/_rels/document.xml.rels": rels(("s", "styles", "../../x.xml"))}),
    "case": docx("", more={"WORD/document.xml": "x"}), "two rels": docx("", more={"_rels/.rels": rels(("a", "officeDocument", "word/document.xml"), ("b", "officeDocument", "word/document.xml"))}),
}


@pytest.mark.parametrize("name", list(BROKEN))
def test_broken_packages_are_refused(name):
    with pytest.raises(o.ParseError) as e:
        o.parse_office(BROKEN[name], "docx")
    assert e.value.code in ("invalid_document", "limit_exceeded")


def test_ignorable_parts_are_left_out():
    parsed = o.parse_office(docx(f'<w:p><x:y><w:r><w:t>gone</w:t></w:r></x:y>{run("stays")}</w:p>', 'xmlns:x="urn:x" mc:Ignorable="x"'), "docx")
    assert parsed["blocks"][0]["text"] == "stays" and o.W_OMITTED in parsed["warnings"]
    utf16 = f'<w:document xmlns:w="{o.WORD}"><w:body><w:p>{run("é")}</w:p></w:body></w:document>'.encode("utf-16")
    assert o.parse_office(docx("", more={"word/document.xml": utf16}), "docx")["blocks"][0]["text"] == "é"


def test_sheets_that_contradict_themselves():
    for sheet in ('<sheetData><row r="1"><c r="A2"/></row></sheetData>', '<sheetData><row><c r="A1"/><c r="A1"/></row></sheetData>', '<sheetData><row><c r="A1" t="s"><v>9</v></c></row></sheetData>', '<sheetData><row><c r="A1" s="9"/></row></sheetData>', '<cols><col min="1" max="2"/><col min="2" max="3"/></cols>'):
        with pytest.raises(o.ParseError):
            o.parse_office(xlsx(sheet), "xlsx")


# A parsed document and its normalised form, byte for byte.
PARSED = '{"schemaVersion":1,"format":"docx","warnings":["旧Word"],"blocks":[{"kind":"paragraph","location":"本文 / 段落 1","style":"Title","text":"Ａ 旧本文"},{"kind":"table","location":"表1","rows":[[{"location":"表1/1/1","text":"左","columnSpan":2,"verticalMerge":"restart"},{"location":"表1/1/2","text":"","columnSpan":1,"verticalMerge":""}]]}]}'
NORMALIZED = '{"schemaVersion":1,"format":"docx","dateSystem":null,"warnings":["旧Word"],"groups":[{"kind":"paragraph","location":"本文 / 段落 1","units":[{"row":null,"members":[{"kind":"word_paragraph","source":{"kind":"paragraph","location":"本文 / 段落 1","text":"Ａ 旧本文","style":"Title"},"searchText":"a 旧本文"}]}]},{"kind":"table","location":"表1","units":[{"row":1,"members":[{"kind":"word_cell","source":{"location":"表1/1/1","text":"左","columnSpan":2,"verticalMerge":"restart"},"searchText":"左"},{"kind":"word_cell","source":{"location":"表1/1/2","text":"","columnSpan":1,"verticalMerge":""},"searchText":""}]}]}]}'


def test_normalised_bytes():
    assert o.to_json(normalize.normalize(json.loads(PARSED))) == NORMALIZED and normalize.verify(NORMALIZED, json.loads(PARSED))
    assert not normalize.verify(NORMALIZED.replace("左", "右"), json.loads(PARSED))


def test_normalisation_refuses():
    cell = {"address": "A1", "row": 1, "column": 1, "value": "x", "valueType": "n", "formula": None, "formulaKind": "", "numberFormat": "", "hiddenRow": False}
    book = lambda *cells, merges=(): {"schemaVersion": 1, "format": "xlsx", "warnings": [], "dateSystem": "1900", "sheets": [{"name": "n", "state": "visible", "part": "p", "cells": list(cells), "merges": list(merges)}]}
    out = normalize.normalize(book(cell | {"address": "B2", "row": 2, "column": 2}, cell, merges=["A1:B2"]))
    assert [u["row"] for u in out["groups"][0]["units"]] == [1, 2] and out["groups"][0]["units"][0]["members"][0]["source"]["hiddenColumn"] is None
    for bad in (book(cell, cell), book(cell | {"row": 2}), book(cell | {"hiddenRow": 1}), book(cell, merges=["B2:A1"]), book(cell, merges=["A1"]), {"schemaVersion": 2}, book(cell) | {"dateSystem": "1901"}):
        with pytest.raises(normalize.NormalizeError):
            normalize.normalize(bad)


def test_parsing_in_a_child():
    data = docx(f"<w:p>{run('x')}</w:p>")
    assert o.parse_in_child(data, "docx") == o.parse_office(data, "docx")
    with pytest.raises(o.ParseError) as e:
        o.parse_in_child(b"junk", "docx")
    assert e.value.code == "invalid_document"


# --- folders and blobs -------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "sub" / "a.docx").write_bytes(docx(f"<w:p>{run('hello')}</w:p>"))
    (root / "b.xlsx").write_bytes(xlsx('<sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData>'))
    (root / "sub" / "deep" / "x.txt").write_text("text")
    (root / "empty").write_text("")
    (root / "~$lock.docx").write_text("x")
    (root / "bad.docx").write_text("junk")
    (root / "back\\slash").write_text("x")
    os.symlink(root / "b.xlsx", root / "link")
    (root / "h1").write_text("h")
    os.link(root / "h1", root / "h2")
    for k in range(20):
        (root / f"f{k}.txt").write_text(f"contents of f{k}")
    return root


def test_walk(spark, tree):
    rows = {r.stable_key or r.subtree_key: r for r in folder.enumerate_folder(spark, str(tree), "s").collect()}
    kinds = {k: r.kind for k, r in rows.items() if r.kind != "entry"}
    assert kinds == {"~$lock.docx": "office_temporary_file", "link": "not_a_regular_file", "h1": "hard_linked", "h2": "hard_linked", "back\\slash": "unusable_name"}
    assert rows["link"].entry_kind == "symlink" and rows["h1"].link_count == 2 and rows["sub/deep/x.txt"].size_bytes == 4
    assert len({r.enum_seq for r in rows.values()}) == len(rows)
    gone = [tuple(r) for r in folder.enumerate_folder(spark, str(tree / "nowhere"), "s").select("kind", "subtree_key", "error_kind").collect()]
    assert gone == [("unlistable_subtree", ".", "ENOENT")]


def test_names_and_fingerprints(spark):
    assert folder.name_rejection("a�") == "replacement_character" and folder.name_rejection("a\0") == "separator_or_nul" and folder.name_rejection("a:b") is None and folder.name_rejection("a:b", True) == "reserved_character"
    assert folder.fingerprint(1999.9, 3) == "1999:3" and not folder.is_lock_file("～$x")
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\\b", 1999.9, 3)], "n string, m double, s long")
    assert tuple(df.select(folder.rejection_column(F.col("n")), folder.fingerprint_column(F.col("m"), F.col("s"))).first()) == ("separator_or_nul", "1999:3")


def test_keys_stay_inside(tree):
    assert folder.safe_path(str(tree), "sub/a.docx").endswith("a.docx")
    for bad in ("", "/etc/passwd", "../x", "sub/../b.xlsx", "sub//a.docx", "./b.xlsx", "link", "sub", "h1"):
        with pytest.raises((folder.ContainmentError, OSError)):
            folder.safe_path(str(tree), bad)
    assert folder.read_outcome(str(tree), "b.xlsx", 3)["kind"] == "size_mismatch" and folder.read_outcome(str(tree), "none", 3)["error_kind"] == "ENOENT"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_blobs(spark, tmp_path, scheme):
    local = str(tmp_path / "blobs")
    store = blobs.BlobStore(scheme + local)
    key, created = store.put(b"x", 1)
    assert created and store.put(b"x") == (key, False) and store.verify(key, key) and store.get(key, key) == b"x"
    assert store.put(b"")[0].startswith("e3b0c442") and not store.verify("ab" * 32, key)
    with pytest.raises(errors.SizeMismatchError):
        store.put(b"x", 2)
    with open(blobs.blob_path(local, key), "wb") as f:
        f.write(b"torn")
    with pytest.raises(errors.BlobDivergenceError):
        store.put(b"x")
    with pytest.raises(errors.BlobDivergenceError):
        store.get(key, key)
    refs = spark.createDataFrame([(key, key), ("ab" * 32, "ab" * 32)], "blob_key string, content_hash string")
    assert [r.verified for r in blobs.verify_references(refs, blobs.stored_blobs(spark, store.root)).collect()] == [False, False]
    store.restore(key, b"x", 1)
    assert sorted(r.verified for r in blobs.verify_references(refs, blobs.stored_blobs(spark, store.root)).collect()) == [False, True]
    with pytest.raises(FileNotFoundError):
        store.get_unverified("ab" * 32)
    with pytest.raises(NotImplementedError):
        store.delete(key)
    for bad in ("ab", "AB12", "../x"):
        with pytest.raises(ValueError):
            blobs.blob_path("r", bad)
    assert not os.listdir(os.path.join(local, "tmp"))


def test_torn_blobs_stop_or_are_repaired(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.txt").write_bytes(b"one")
    store = blobs.BlobStore(str(tmp_path / "blobs"))
    key = store.put_bytes(b"one")
    with open(blobs.blob_path(store.root, key), "wb") as f:
        f.write(b"torn")
    read = lambda **k: folder.read_outcome(str(tmp_path / "root"), "a.txt", 3, store.put_bytes, **k)
    with pytest.raises(errors.BlobDivergenceError):
        read()
    assert read(restore=store.restore)["content_hash"] == key and store.verify(key, key)
    def odd(data):
        raise RuntimeError("odd")
    assert folder.read_outcome(str(tmp_path / "root"), "a.txt", 3, odd)["error_kind"] == "RuntimeError"


# --- manifests ---------------------------------------------------------------------------


def test_one_writer_wins_and_readers_are_pinned(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = store.publish(store.pin(), {"t": spark.range(3)})
    two = store.publish(one, {"t": spark.range(5), "u": spark.range(1)}, {"k": 1})
    assert (one["t"].count(), two["t"].count(), store.pin(1)["t"].count(), store.latest()) == (3, 5, 3, 2)
    with pytest.raises(errors.ManifestConflictError):
        store.publish(one, {"t": spark.range(9)})
    assert store.pin()["t"].count() == 5 and store.pin().control == {"k": 1}
    store.backup(str(tmp_path / "backup"))
    assert json.load(open(tmp_path / "backup" / "COMPLETE.json"))["tables"] == ["t", "u"]


def test_half_written_manifests_are_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = store.publish(store.pin(), {"t": spark.range(3)})
    (tmp_path / "store" / "manifests" / "0.aside").write_text("{")  # a writer that stopped
    assert store.latest() == 1 and store.publish(one, {}).version == 2
    with pytest.raises(FileExistsError):
        store._place(str(tmp_path / "store" / "manifests" / "0.aside"), store._manifest(2))
    assert not [p for p in os.listdir(tmp_path / "store" / "manifests") if p.endswith(".aside") and p != "0.aside"]


def test_appends_write_only_what_they_add(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    one = store.publish(store.pin(), {"t": spark.range(3).selectExpr("id AS a", "'x' AS b")})
    two = store.publish(one, {}, appends={"t": spark.range(2).selectExpr("cast(id AS int) AS a")})
    assert two.folders["t"][0] == one.folders["t"][0] and len(two.folders["t"]) == 2
    assert (two["t"].schema, one["t"].count(), two["t"].count(), two["t"].where("b IS NULL").count()) == (one["t"].schema, 3, 5, 2)
    three = store.publish(two, {}, appends={"t": two["t"].limit(0)})
    assert three.folders == two.folders
    monkeypatch.setattr("tessera.plans.manifest.MOST_FOLDERS", 2)
    four = store.publish(three, {}, appends={"t": spark.range(1).selectExpr("id AS a")})
    assert len(four.folders["t"]) == 1 and four["t"].count() == 6 and two["t"].count() == 5


def test_digests_and_upgrade(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert table_digest(a) == table_digest(a.orderBy(a.a.desc()).select("b", "a")) != table_digest(a.limit(1))
    store = Store(spark, str(tmp_path / "store"))
    store.publish(store.pin(), {"t": a})
    want = {"t": "a bigint, b string, c int"}
    assert schema_status(store.pin(), want) == "older" and schema_status(store.pin(), {"t": "a string, b string"}) == "unsupported"
    now = upgrade(store, want)
    assert schema_status(now, want) == "current" and now["t"].where("c IS NULL").count() == 2 and upgrade(store, want).version == now.version
    with pytest.raises(errors.StoreError):
        upgrade(store, {"t": "a string"})


# --- the engine --------------------------------------------------------------------------


def test_engine(spark, tree, tmp_path):
    n = itertools.count(1)
    e = Engine(spark, str(tmp_path / "data"), clock=lambda: 1_700_000_000_000 + next(n), new_id=lambda: f"scan{next(n)}")
    source = e.register(str(tree), "test")
    assert e.register(str(tree)) == source and e.snapshot()["source"].count() == 1
    with pytest.raises(ValueError):
        e.register(str(tmp_path / "data" / "blobs") if (tmp_path / "data" / "blobs").exists() else str(tmp_path))
    report = e.scan(source)
    assert report.scan.status == "completed" and report.counts["versions_created"] == 25
    assert e.parse() == {"claimed": 3, "succeeded": 2} and e.normalize() == {"claimed": 2, "succeeded": 2}
    before, files = e.tables(), e.snapshot().folders
    assert e.scan(source).counts["versions_created"] == 0 and e.normalize()["claimed"] == 0
    # an unchanged scan adds no file to the tables that only grow, and leaves nothing of its work
    assert all(e.snapshot().folders[t] == files[t] for t in ("document_version", "derivation", "artifact", "processing_run", "source"))
    assert not os.listdir(tmp_path / "data" / "work")
    results = e.audit(replay=(before, e.tables()), vectors=[("a", "b", "b")], known_sources=[source])
    audit.assert_invariants(results, [r for r in audit.INVARIANTS if r not in ("HASH_MATCHES_BLOB", "IDEMPOTENT_REPLAY")])
    os.unlink(tree / "f0.txt")
    assert e.scan(source).deleted == 1 and e.search("F1").count() == 11
    version = e.snapshot()["document"].where("stable_key = 'b.xlsx'").first()["active_version_id"]
    assert json.loads(e.content(version)[0])["sheets"][0]["cells"][0]["value"] == "5" and len(e.content(version, "normalized_document")) == 1
    assert len(e.content(version, artifact_id="none")) == 0 and e.original(version)[1] == "b.xlsx"
    assert {(r.form, r.status) for r in e.parse_status().where("form IS NOT NULL").collect()} == {("docx", "ready"), ("docx", "failed"), ("xlsx", "ready")} and e.parse_status().where("status = 'unsupported'").count() > 0
    told = e.diagnostics()
    assert [x["status"] for x in told["scans"]] == ["completed"] * 3 and told["sources"][0]["source_id"] == source and json.dumps(told, default=str)
    t = e.tables()
    assert normalize.normalization_findings(t).count() == 0
    members = normalize.members_of(t["artifact"].where("type = 'normalized_document'").withColumnRenamed("inline_content", "content"), "artifact_id")
    assert {r.place for r in members.collect()} == {"A!A1", "本文 / 段落 1"}
    broken = dict(t)
    broken["artifact"] = t["artifact"].withColumn("inline_content", t["artifact"].inline_content.substr(1, 20))
    assert {r.detail for r in normalize.normalization_findings(broken).collect()} == {"parent"}
    with pytest.raises(errors.NotFoundError):
        e.scan("unknown")
    e.backup(str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "COMPLETE.json").exists()


def test_divergence_and_late_workers_are_noted(spark, tree, tmp_path):
    now = itertools.count(1_700_000_000_000)
    late = []
    e = Engine(spark, str(tmp_path / "data"), clock=lambda: next(now) + sum(late), new_id=lambda: f"scan{next(now)}")
    e.scan(e.register(str(tree), "test"))
    kinds = lambda kind: e.snapshot()["observation"].where(f"kind = '{kind}'")
    compute = e._keep

    def slow(df):
        late.append(1_000_000)  # the lease runs out meanwhile
        return compute(df)

    e._keep = slow
    assert e.parse() == {"claimed": 3, "succeeded": 0} and kinds("stale_worker_rejected").count() == 3 and e.snapshot()["artifact"].count() == 0
    e._keep = compute
    assert e.parse() == {"claimed": 3, "succeeded": 2} and kinds("run_failed").count() == 1
    assert {r.attempt for r in e.snapshot()["processing_run"].where("status <> 'abandoned'").collect()} == {2}
    s = e.snapshot()
    keys = sorted(r.derivation_key for r in s["derivation"].collect())
    stored = s["derivation"].withColumn("outputs_hash", F.when(F.col("derivation_key") == keys[0], "other").otherwise(F.col("outputs_hash"))).where(F.col("derivation_key") == keys[0])
    e.store.publish(s, {"derivation": stored, "artifact": s["artifact"].limit(0), "processing_run": s["processing_run"].limit(0)})
    with pytest.raises(errors.DerivationDivergenceError):
        e.parse()
    # the divergent derivation is noted, the other one committed
    assert [json.loads(r.detail)["derivationKey"] for r in kinds("derivation_output_divergence").collect()] == [keys[0]]
    assert {r.derivation_key for r in e.snapshot()["artifact"].collect()} == {keys[1]}
    assert e.snapshot()["processing_run"].where("error_kind = 'derivation_divergence' AND status = 'failed'").count() == 1
    seq = [r.observation_seq for r in e.snapshot()["observation"].collect()]
    assert sorted(seq) == list(range(1, len(seq) + 1))
    # a normalised artifact of another content is refused
    with pytest.raises(ValueError):
        e._derive(_normalised(e), lambda new: new.withColumns({"content": F.lit("{}"), "error": F.lit(None).cast("string")}), "normalized_document", gate=normalize.check_commit)


def _normalised(e):
    a = e.snapshot()["artifact"].select("document_id", "root_version_id", F.to_json(F.array("artifact_id")).alias("input_ids"))
    return a.select("*", F.lit("k").alias("derivation_key"), F.lit(normalize.NORMALIZER_NAME).alias("processor_name"), F.lit("1").alias("processor_version"), F.lit(normalize.config_hash()).alias("config_hash"))


def test_interrupted_and_failed_scans(spark, tmp_path):
    n = itertools.count(1)
    e = Engine(spark, str(tmp_path / "data"), clock=lambda: next(n), new_id=lambda: f"scan{next(n)}")
    root = tmp_path / "in"
    root.mkdir()
    for k in range(3):
        (root / f"f{k}").write_text(str(k))
    source = e.register(str(root))

    def stop(scan, missing):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        e.scan(source, review=stop)
    left = e.snapshot()
    running = [s for s in left.control["scans"] if s["status"] == "running"]
    assert len(running) == 1 and left["document"].count() == 3  # what was ingested stays
    with pytest.raises(errors.ConcurrentScanError):
        e.scan(source)

    def fail(scan, missing):
        raise ValueError("no")

    with pytest.raises(ValueError):
        e.scan(source, interrupted=running[0]["scan_id"], review=fail)
    assert [s["status"] for s in e.snapshot().control["scans"]] == ["failed", "failed"]
    assert e.scan(source).scan.status == "completed" and e.scan(source).scan.previous_distinct_count == 3
    other = e.snapshot()
    e.scan(source)  # from now on the store refuses a writer whose base is older
    with pytest.raises(errors.ManifestConflictError):
        e.store.publish(other, {})


# --- streams -----------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(k, f"o{k}", "version_created" if k % 2 else "entry_skipped", f"d{k % 3}", f"v{k}" if k % 2 else None, "s", None, 1_700_000_000_000 + k * 600_000, "{}") for k in range(20)]
    spark.createDataFrame(rows, TABLES["observation"]).write.parquet(log)
    q = stream.latest_pointers(stream.observation_stream(spark, log)).writeStream.format("memory").queryName("pointers").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.document_id: r.version_id for r in spark.table("pointers").collect()} == {"d0": "v15", "d1": "v19", "d2": "v17"}
    q = stream.kind_counts(stream.observation_stream(spark, log)).writeStream.format("memory").queryName("kinds").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("kinds").collect()) == 20
    seen = []
    q = stream.scan_each_batch(stream.observation_stream(spark, log), lambda df, k: seen.append(df.count()), str(tmp_path / "at"))
    q.awaitTermination(60)
    assert sum(seen) == 20


def test_lease_stream(spark, tmp_path):
    schema = "derivation_key string, event string, observation_seq bigint, expires_at bigint, at timestamp"
    events = str(tmp_path / "events")
    spark.createDataFrame([("k", "claim", 1, 1_700_000_060_000, None), ("j", "claim", 2, 1_700_000_060_000, None), ("j", "succeeded", 3, 0, None)], schema).selectExpr("derivation_key", "event", "observation_seq", "expires_at", "timestamp_millis(1700000000000) AS at").write.parquet(events)
    q = stream.lease_stream(spark.readStream.schema(schema).parquet(events)).writeStream.format("memory").queryName("leases").outputMode("update").start()
    q.processAllAvailable()
    spark.createDataFrame([("z", "claim", 9, 1_800_000_000_000, None)], schema).selectExpr("derivation_key", "event", "observation_seq", "expires_at", "timestamp_millis(1700000900000) AS at").write.mode("append").parquet(events)
    q.processAllAvailable()
    q.stop()
    got = [(r.derivation_key, r.status) for r in spark.table("leases").collect()]
    assert ("j", "succeeded") in got and ("k", "abandoned") in got and ("z", "leased") in got
