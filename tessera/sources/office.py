"""Word and Excel files: what is stored in them, without evaluating anything.

A package's XML parts become small trees; Word bodies become numbered
paragraphs and tables, workbooks become sheets of cells. One document is parsed
in one call with hard limits; the columns below do so for many, an error being
a row's result and never a task's failure.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import subprocess
import sys
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_config_hash
from ..functions.text import BUILTIN_FORMATS, BUILTIN_NAME, LAST_COLUMN, LAST_ROW, LOCALE_FORMATS, py_is_date_format

LIMITS = {
    "inputBytes": 20 << 20, "expandedBytes": 32 << 20, "entries": 2000, "nodes": 200_000, "depth": 64, "cells": 20_000, "blocks": 20_000, "outputBytes": 8 << 20, "timeoutMs": 30_000,
}
PARSER_NAME, PARSER_VERSION = "office-xml", "office-xml-9"
MEMORY_BYTES = 1 << 30

# Namespaces.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
COMPAT = "http://schemas.openxmlformats.org/markup-compatibility/2006"
XML = "http://www.w3.org/XML/1998/namespace"
UNDERSTOOD = {WORD, SHEET, REL, OFFICE_REL, CONTENT_TYPES, COMPAT, XML, ""}
OPAQUE = {
    "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "http://schemas.openxmlformats.org/drawingml/2006/picture",
    "http://schemas.openxmlformats.org/officeDocument/2006/math", "urn:schemas-microsoft-com:vml", "urn:schemas-microsoft-com:office:office", "urn:schemas-microsoft-com:office:word",
}
MAIN_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml",
}

# Warnings and notes that are part of stored results.
W_LAYOUT = "印刷レイアウト・ページ番号は再現しません。出典は本文内の段落・表の位置です。画像・図形・ヘッダー・フッター・脚注・コメントは抽出対象外です。"
W_OMITTED = "未対応の拡張・代替要素を省略しています。その中の文字は表示しません。原本で確認してください。"
W_HIDDEN_TEXT = "抽出対象の本文は隠し文字も含めて抽出します。Wordの表示・印刷と異なる場合があります。隠し文字の範囲表示や、表示設定に合わせた文字の省略は行いません。"
W_EMBEDDED = "画像・図形・埋め込み・代替要素があります。その中の文字は読み取っていません。原本を確認してください。"
W_TRACKED = "変更履歴があります。挿入後の文章を表示し、削除・移動元の文章は表示しません。承認済みを意味しません。"
W_FIELDS = "差し込み・日付・ページ番号などのフィールドがあります。表示するのは原本に保存された結果で、Wordで開き直すと変わる場合があります。フィールドの計算はしません。"
W_VANISH = "文書またはスタイルに隠し文字の設定を検出しました。解除設定や未使用スタイルも含むため、実際に非表示になる箇所は原本で確認してください。"
W_NUMBERED = "箇条書き・段落番号の自動採番があります。番号や行頭記号は原本の本文に保存されていないため表示しません。番号で参照する資料は原本を確認してください。"
W_NOTHING = "抽出対象の文字はありません。画像だけの資料や空の資料では、原本を確認してください。"
W_RUBY = "ルビは親文字（読み）の形で表示します。括弧は読みを区別するための表示で、原本の文字ではありません。"
W_SYMBOL = "本文中の「［記号未再現（…）］」は原本の文字ではなく、表示できない記号の位置を示す注記です。フォントとコードを残しています。記号の形・意味は原本で確認してください。"
W_NESTED = "{0}に入れ子の表があります。セル内の文章として表示します。"
W_VALUES = "値はファイルに保存された値です。数式は再計算せず、結果が古い可能性があります。日付・通貨・桁区切りなどの表示書式は適用せず、保存値と書式を併記します。画像・グラフ・コメントは抽出対象外です。"
W_HIDDEN_PARTS = "非表示のシート・行・列も抽出対象です。フィルターや印刷範囲による省略は行いません。"
W_SERIAL = "「{0}」の{1}{2}は日付・時刻の書式です。値は{3}年方式の連番で保存されており、Excelの画面表示とは異なります。書式を適用した日付に変換しません。"
W_MORE = " ほか{0}件"
W_NO_RESULT = "「{0}」には保存された計算結果のない数式があります。値を推測して補いません。"
W_SHARED = "「{0}」の共有・配列数式は、保存されている式だけを表示します。空の式は未保存であり、数式なしを意味しません。"
W_PREFIX = "「{0}」の数式には保存用の接頭辞 _xlfn. が含まれます。保存式をそのまま示し、Excel画面の式への変換や再計算は行いません。"
W_OMITTED_PARTS = "未対応の拡張・代替要素を省略しています。省略した部品: {0}。その中の値や設定は表示しません。原本で確認してください。"
N_SYMBOL, N_UNSET = "［記号未再現（フォント: {0} / コード: {1}）］", "未指定"
N_LOCALE = "（地域依存。Excelの表示は環境によって変わります）"
P_PARAGRAPH, P_TABLE, P_CELL = "本文 / 段落 {0}", "本文 / 表 {0}", "{0} / 行 {1} / セル {2}"
P_BOOK, P_STYLES, P_STRINGS, P_SHEET = "ブック設定", "書式", "共有文字列", "シート「{0}」"


class ParseError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _bad(message: str) -> ParseError:
    return ParseError("invalid_document", message)


def _over(kind: str) -> ParseError:
    return ParseError("limit_exceeded", f"more than the limit of {kind}: {LIMITS[kind]}")


# --- package -----------------------------------------------------------------------------


def read_package(content: bytes) -> dict[str, bytes]:
    """The XML parts of a package by name. All entries are expanded and counted, whatever sizes they declare."""
    if len(content) > LIMITS["inputBytes"]:
        raise _over("inputBytes")
    out: dict[str, bytes] = {}
    seen: set[str] = set()
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            name = entry.orig_filename
            if "\\" in name or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
                raise _bad(f"malformed part name {name!r}")
            if _has_extra(entry.extra, 0x7075):
                raise _bad("a Unicode path is given beside the name")
            if name.lower() in seen:
                raise _bad("part names meet but for case")
            seen.add(name.lower())
            if len(seen) > LIMITS["entries"]:
                raise _over("entries")
            if entry.flag_bits & 1:
                raise ParseError("encrypted", "the package is encrypted")
            if name.endswith("/"):
                continue
            keep = name.endswith((".xml", ".rels"))
            pieces = []
            with archive.open(entry) as stream:
                while piece := stream.read(1 << 16):
                    total += len(piece)
                    if total > LIMITS["expandedBytes"]:
                        raise _over("expandedBytes")
                    if keep:
                        pieces.append(piece)
            if keep:
                out[name] = b"".join(pieces)
    return out


def _has_extra(extra: bytes, wanted: int) -> bool:
    at = 0
    while at + 4 <= len(extra):
        if int.from_bytes(extra[at : at + 2], "little") == wanted:
            return True
        at += 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
    return False


class Node:
    __slots__ = ("uri", "name", "attrs", "kids", "text", "keeps_space", "skip", "ignorable", "omitted")

    def __init__(self, uri: str, name: str, parent: Node | None):
        self.uri, self.name, self.attrs, self.kids, self.text, self.omitted = uri, name, {}, [], "", False
        self.keeps_space = parent.keeps_space if parent else False
        self.skip = parent.skip if parent else False
        self.ignorable: frozenset[str] = parent.ignorable if parent else frozenset()

    def get(self, name: str, uri: str = "") -> str:
        return self.attrs.get((uri, name), "")

    def all(self, name: str, uri: str) -> list[Node]:
        return [k for k in self.kids if not k.skip and k.name == name and k.uri == uri]

    def first(self, name: str, uri: str) -> Node | None:
        return next(iter(self.all(name, uri)), None)

    def deep(self) -> Iterator[Node]:
        for k in self.kids:
            if not k.skip:
                yield k
                yield from k.deep()

    @property
    def saved(self) -> str:
        return self.text if self.keeps_space else self.text.strip(" \t\r\n")


def _w(node: Node | None) -> str:
    return node.get("val", WORD) if node else ""


def _decoded(part: bytes) -> str:
    encoding = "utf-8"
    if part[:2] in (b"\xff\xfe", b"<\0"):
        encoding = "utf-16-le"
    elif part[:2] in (b"\xfe\xff", b"\0<"):
        encoding = "utf-16-be"
    return part.decode(encoding).removeprefix("\ufeff")


def _split(name: str) -> tuple[str, str]:
    uri, _, local = name.rpartition(" ")
    return uri, local


def read_xml(parts: dict[str, bytes], name: str, uri: str, root_name: str) -> Node:
    """The tree of one part. No DTD, XML 1.0 only; what can't be told to be ignorable is refused."""
    if name not in parts:
        raise _bad(f"the part {name} is missing")
    text = _decoded(parts[name])
    stack: list[Node] = []
    roots: list[Node] = []
    prefixes: dict[str, list[str]] = {"xml": [XML]}
    count = {"nodes": 0, "cells": 0}
    parser = expat.ParserCreate("utf-8", " ")
    parser.buffer_text = True

    def version(number: str, *_: object) -> None:
        if number != "1.0":
            raise _bad("not XML 1.0")

    def doctype(*_: object) -> None:
        raise _bad("a DTD")

    def bind(prefix: str | None, target: str | None) -> None:
        prefixes.setdefault(prefix or "", []).append(target or "")

    def unbind(prefix: str | None) -> None:
        prefixes[prefix or ""].pop()

    def opened(tag: str, attributes: dict[str, str]) -> None:
        count["nodes"] += 1
        if count["nodes"] > LIMITS["nodes"]:
            raise _over("nodes")
        if len(stack) >= LIMITS["depth"]:
            raise _over("depth")
        node = Node(*_split(tag), stack[-1] if stack else None)
        if (node.uri, node.name) == (WORD, "tc"):
            count["cells"] += 1
            if count["cells"] > LIMITS["cells"]:
                raise _over("cells")
        node.attrs = {_split(k): v for k, v in attributes.items()}
        space = node.get("space", XML)
        if space not in ("", "preserve", "default"):
            raise _bad("a malformed xml:space")
        if space:
            node.keeps_space = space == "preserve"
        if not node.skip:
            _admit(node, uri, prefixes)
            if node.skip and roots:
                roots[0].omitted = True
        if stack:
            stack[-1].kids.append(node)
        else:
            roots.append(node)
        stack.append(node)

    def said(data: str) -> None:
        if stack:
            stack[-1].text += data

    parser.XmlDeclHandler, parser.StartDoctypeDeclHandler = version, doctype
    parser.StartNamespaceDeclHandler, parser.EndNamespaceDeclHandler = bind, unbind
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, lambda _: stack.pop(), said
    parser.Parse(text.encode(), True)
    if not roots or (roots[0].uri, roots[0].name) != (uri, root_name):
        raise _bad(f"the part {name} has another form")
    return roots[0]


def _admit(node: Node, part_uri: str, prefixes: dict[str, list[str]]) -> None:
    """Marks a node that is skipped with all it holds, and refuses what is neither understood nor ignorable."""
    for prefix in node.get("Ignorable", COMPAT).split():
        known = prefixes.get(prefix) or [""]
        if not known[-1]:
            raise _bad("an unknown ignorable prefix")
        node.ignorable |= {known[-1]}
    for attr_uri, attr in node.attrs:
        if attr_uri == COMPAT and attr != "Ignorable":
            raise _bad("an unsupported compatibility rule")
        if attr_uri not in UNDERSTOOD and attr_uri not in OPAQUE and attr_uri not in node.ignorable:
            raise _bad("an attribute of an unknown namespace")
    extension = part_uri == SHEET and (node.uri, node.name) == (SHEET, "extLst")
    alternate = (node.uri, node.name) == (COMPAT, "AlternateContent")
    if extension or alternate or node.uri in OPAQUE or (node.uri not in UNDERSTOOD and node.uri in node.ignorable):
        node.skip = True
    elif not node.uri or node.uri not in UNDERSTOOD:
        raise _bad("an element of an unknown namespace")


def relations(parts: dict[str, bytes], owner: str, required: bool = True) -> dict[str, Node]:
    folder, base = posixpath.split(owner)
    path = posixpath.join(folder, "_rels", f"{base}.rels")
    if not required and path not in parts:
        return {}
    out: dict[str, Node] = {}
    for r in read_xml(parts, path, REL, "Relationships").all("Relationship", REL):
        key = r.get("Id")
        if not key or key in out:
            raise _bad("a missing or repeated relation id")
        out[key] = r
    return out


def target(relation: Node, owner: str) -> str:
    if relation.get("TargetMode") not in ("", "Internal"):
        raise _bad("an external part")
    raw = relation.get("Target")
    if not raw or re.search(r"[\\:%#?]", raw):
        raise _bad("a malformed target")
    path = posixpath.normpath(raw[1:] if raw.startswith("/") else posixpath.join(posixpath.dirname(owner), raw))
    if path in (".", "..") or path.startswith(("../", "/")):
        raise _bad("a target outside the package")
    return path


def of_type(rels: dict[str, Node], kind: str) -> Node | None:
    found = [r for r in rels.values() if r.get("Type") == f"{OFFICE_REL}/{kind}"]
    if len(found) > 1:
        raise _bad(f"several parts of the type {kind}")
    return found[0] if found else None


def main_part(parts: dict[str, bytes], form: str) -> str:
    rel = of_type(relations(parts, ""), "officeDocument")
    if rel is None:
        raise _bad("no main part")
    path = target(rel, "")
    types = [t.get("ContentType") for t in read_xml(parts, "[Content_Types].xml", CONTENT_TYPES, "Types").all("Override", CONTENT_TYPES) if t.get("PartName") == f"/{path}"]
    if types != [MAIN_TYPES[form]]:
        raise _bad("the main part is of another type than the name says")
    return path


# --- Word --------------------------------------------------------------------------------

_GONE = {"del", "moveFrom"}
_PLAIN = {"noBreakHyphen": "\u2011", "tab": "\t", "br": "\n", "cr": "\n"}


def is_private_use(code: int) -> bool:
    return 0xE000 <= code <= 0xF8FF or 0xF0000 <= code <= 0xFFFFD or 0x100000 <= code <= 0x10FFFD


class _Word:
    def __init__(self) -> None:
        self.warnings: list[str] = []

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    def symbol(self, font: str, code: str) -> str:
        self.warn(W_SYMBOL)
        return N_SYMBOL.format(font or N_UNSET, code or N_UNSET)

    def spoken(self, node: Node, font: str = "") -> str:
        """The words of a paragraph's tree; the font is carried down for symbols whose shape it decides."""
        if node.skip or node.name == "AlternateContent":
            return ""
        if node.uri == WORD:
            name = node.name
            if name in _GONE or name in ("pPr", "rPr", "txbxContent"):
                return ""
            if name in _PLAIN:
                return _PLAIN[name]
            if name == "t":
                return "".join(self.symbol(font, f"{ord(c):04X}") if is_private_use(ord(c)) else c for c in node.saved)
            if name == "sym":
                return self.symbol(node.get("font", WORD) or font, node.get("char", WORD))
            if name == "ruby":
                base, reading = node.first("rubyBase", WORD), node.first("rt", WORD)
                if base is None or reading is None:
                    raise _bad("a ruby without a base or a reading")
                self.warn(W_RUBY)
                return f"{self.spoken(base, font)}（{self.spoken(reading, font)}）"
            if name == "r":
                props = node.first("rPr", WORD)
                fonts = props.first("rFonts", WORD) if props else None
                font = next((v for a in ("ascii", "hAnsi", "eastAsia") if fonts and (v := fonts.get(a, WORD))), font)
        return "".join(self.spoken(k, font) for k in node.kids)

    def cell_lines(self, node: Node) -> Iterator[str]:
        if node.skip or node.name == "AlternateContent" or (node.uri == WORD and (node.name in _GONE or node.name == "txbxContent")):
            return
        if (node.uri, node.name) == (WORD, "p"):
            yield self.spoken(node)
            return
        for k in node.kids:
            yield from self.cell_lines(k)


def _table_kids(node: Node, name: str) -> Iterator[Node]:
    """Rows or cells of a table, also inside wrappers of its own level, but not of tables within."""
    for k in node.kids:
        if k.skip or k.uri != WORD:
            continue
        if k.name == name:
            yield k
        elif k.name == "customXml":
            yield from _table_kids(k, name)
        elif k.name == "sdt" and (content := k.first("sdtContent", WORD)):
            yield from _table_kids(content, name)


def _names(root: Node, uri: str | None = None) -> set[str]:
    return {n.name for n in root.deep() if uri is None or n.uri == uri}


def parse_word(parts: dict[str, bytes], main: str) -> dict[str, Any]:
    doc = read_xml(parts, main, WORD, "document")
    body = doc.first("body", WORD)
    if body is None:
        raise _bad("no body")
    word = _Word()
    style_rel = of_type(relations(parts, main, False), "styles")
    styles_root = read_xml(parts, target(style_rel, main), WORD, "styles") if style_rel else None
    anything, own = _names(doc), _names(doc, WORD)
    styled = _names(styles_root, WORD) if styles_root else set()
    for applies, message in (
        (True, W_LAYOUT), (doc.omitted, W_OMITTED), (True, W_HIDDEN_TEXT), (anything & {"drawing", "pict", "txbxContent", "altChunk", "object", "AlternateContent"}, W_EMBEDDED),
        (own & {"ins", "del", "moveFrom", "moveTo"}, W_TRACKED), (own & {"fldChar", "fldSimple", "instrText"}, W_FIELDS), ("vanish" in own | styled, W_VANISH), ("numPr" in own | styled, W_NUMBERED),
    ):
        if applies:
            word.warn(message)
    styles = {s.get("styleId", WORD): _w(s.first("name", WORD)) for s in (styles_root.all("style", WORD) if styles_root else ())}
    blocks: list[dict[str, Any]] = []
    number = {"p": 0, "tbl": 0, "tc": 0}

    def cell(tc: Node, location: str, r: int, c: int) -> dict[str, Any]:
        number["tc"] += 1
        if number["tc"] > LIMITS["cells"]:
            raise _over("cells")
        props = tc.first("tcPr", WORD)
        span_text = _w(props.first("gridSpan", WORD)) if props else ""
        merged = props.first("vMerge", WORD) if props else None
        try:
            span = int(span_text or 1)
        except ValueError:
            span = 0
        if not 1 <= span <= 1000:
            raise _bad("a malformed cell span")
        if "tbl" in _names(tc, WORD):
            word.warn(W_NESTED.format(location))
        return {
            "location": P_CELL.format(location, r, c), "text": "\n".join(word.cell_lines(tc)), "columnSpan": span, "verticalMerge": (_w(merged) or "continue") if merged is not None else "",
        }

    def visit(node: Node) -> None:
        if node.skip or node.name == "AlternateContent" or (node.uri == WORD and node.name in _GONE):
            return
        if (node.uri, node.name) == (WORD, "p"):
            number["p"] += 1
            props = node.first("pPr", WORD)
            style = _w(props.first("pStyle", WORD)) if props else ""
            blocks.append({"kind": "paragraph", "location": P_PARAGRAPH.format(number["p"]), "text": word.spoken(node), "style": styles.get(style, style)})
        elif (node.uri, node.name) == (WORD, "tbl"):
            number["tbl"] += 1
            location = P_TABLE.format(number["tbl"])
            rows = [[cell(tc, location, r, c) for c, tc in enumerate(_table_kids(tr, "tc"), 1)] for r, tr in enumerate(_table_kids(node, "tr"), 1)]
            blocks.append({"kind": "table", "location": location, "rows": rows})
        else:
            for k in node.kids:
                visit(k)

    for k in body.kids:
        visit(k)
    if len(blocks) > LIMITS["blocks"]:
        raise _over("blocks")
    if not any(b["text"] if b["kind"] == "paragraph" else any(c["text"] for r in b["rows"] for c in r) for b in blocks):
        word.warn(W_NOTHING)
    return {"schemaVersion": 1, "format": "docx", "warnings": word.warnings, "blocks": blocks}


# --- Excel -------------------------------------------------------------------------------

_YES = ("1", "true")


def excel_string(text: str) -> str:
    """``_xHHHH_`` as the UTF-16 unit it stands for, once; pairs of units become one character."""
    out = re.sub(r"_x([0-9a-fA-F]{4})_", lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") if out is not text else out


def _rich(node: Node) -> str:
    return "".join(excel_string(k.saved) if k.name == "t" else _rich(k) if k.name == "r" else "" for k in node.kids if not k.skip and k.uri == SHEET)


class _Book:
    """The shared parts of a workbook."""

    def __init__(self, parts: dict[str, bytes], main: str):
        self.parts, self.main = parts, main
        self.root, self.rels = read_xml(parts, main, SHEET, "workbook"), relations(parts, main)
        strings, styles = self.shared("sharedStrings", "sst"), self.shared("styles", "styleSheet")
        self.strings = [_rich(s) for s in strings.all("si", SHEET)] if strings else []
        codes = styles.first("numFmts", SHEET) if styles else None
        self.codes = {f.get("numFmtId"): f.get("formatCode") for f in (codes.all("numFmt", SHEET) if codes else ())}
        formats = styles.first("cellXfs", SHEET) if styles else None
        self.formats = formats.all("xf", SHEET) if formats else []
        self.omitted = [n for n, r in ((P_BOOK, self.root), (P_STYLES, styles), (P_STRINGS, strings)) if r is not None and r.omitted]
        props = self.root.first("workbookPr", SHEET)
        self.dates = "1904" if props and props.get("date1904") in _YES else "1900"

    def shared(self, kind: str, root: str) -> Node | None:
        rel = of_type(self.rels, kind)
        return read_xml(self.parts, target(rel, self.main), SHEET, root) if rel else None

    def number_format(self, style: str) -> tuple[str, bool]:
        """The stored format of a style index, and whether it shows dates or times."""
        if style and not (style.isdecimal() and style.isascii() and int(style) < len(self.formats)):
            raise _bad("a dangling cell format")
        index = int(style or 0)
        key = (self.formats[index].get("numFmtId") if index < len(self.formats) else "") or "0"
        number = int(key) if key.isdecimal() and key.isascii() else -1
        code = self.codes.get(key, BUILTIN_FORMATS.get(number))
        if code is not None:
            return code, py_is_date_format(code)
        return f"{BUILTIN_NAME} {key}" + (N_LOCALE if number in LOCALE_FORMATS else ""), number in LOCALE_FORMATS

    def value(self, cell: Node, kind: str) -> str | None:
        stored = cell.first("v", SHEET)
        raw = stored.text if stored is not None else None
        if kind == "s":
            if raw is None or not re.fullmatch("[0-9]+", raw) or int(raw) >= len(self.strings):
                raise _bad("a dangling shared string")
            return self.strings[int(raw)]
        if kind == "inlineStr":
            inline = cell.first("is", SHEET)
            return _rich(inline) if inline is not None else ""
        if kind not in ("n", "b", "d", "e", "str"):
            raise _bad("an unknown cell type")
        return excel_string(raw) if kind == "str" and raw is not None else raw


def _hidden_columns(sheet: Node) -> set[int]:
    hidden, defined = set(), set()
    cols = sheet.first("cols", SHEET)
    for col in cols.all("col", SHEET) if cols else ():
        try:
            low, high = int(col.get("min")), int(col.get("max"))
        except ValueError:
            raise _bad("a malformed column range") from None
        if not 1 <= low <= high <= LAST_COLUMN:
            raise _bad("a malformed column range")
        for n in range(low, high + 1):
            if n in defined:
                raise _bad("column ranges overlap")
            defined.add(n)
            if col.get("hidden") in _YES:
                hidden.add(n)
    return hidden


def _sheet_cells(book: _Book, sheet: Node, room: Callable[[], None]) -> tuple[list[dict[str, Any]], list[str]]:
    hidden, seen, cells, serials = _hidden_columns(sheet), set(), [], []
    data = sheet.first("sheetData", SHEET)
    for row in data.all("row", SHEET) if data else ():
        for c in row.all("c", SHEET):
            room()
            address = c.get("r")
            m = re.fullmatch("([A-Z]{1,3})([1-9][0-9]*)", address)
            if not m or address in seen:
                raise _bad("a malformed or repeated cell address")
            seen.add(address)
            column = 0
            for letter in m[1]:
                column = column * 26 + ord(letter) - 64
            number = int(m[2])
            if column > LAST_COLUMN or number > LAST_ROW or (row.get("r") and row.get("r") != str(number)):
                raise _bad("a cell outside its row")
            kind = c.get("t") or "n"
            value, formula = book.value(c, kind), c.first("f", SHEET)
            code, dated = book.number_format(c.get("s"))
            if kind == "n" and value is not None and dated:
                serials.append(address)
            cells.append({
                "address": address, "row": number, "column": column, "value": value, "valueType": kind, "formula": formula.text if formula is not None else None,
                "formulaKind": (formula.get("t") or "normal") if formula is not None else "", "numberFormat": code, "hiddenRow": row.get("hidden") in _YES, "hiddenColumn": column in hidden,
            })
    return cells, serials


def parse_workbook(parts: dict[str, bytes], main: str) -> dict[str, Any]:
    book = _Book(parts, main)
    warnings, sheets, names, used = [W_VALUES, W_HIDDEN_PARTS], [], set(), set()
    count = 0

    def room() -> None:
        nonlocal count
        count += 1
        if count > LIMITS["cells"]:
            raise _over("cells")

    listed = book.root.first("sheets", SHEET)
    for s in listed.all("sheet", SHEET) if listed else ():
        name, rel = excel_string(s.get("name")), book.rels.get(s.get("id", OFFICE_REL))
        if rel is None or rel.get("Type") != f"{OFFICE_REL}/worksheet":
            raise _bad("a sheet that is no worksheet")
        part = target(rel, main)
        if not name or name in names or part in used:
            raise _bad("a repeated sheet")
        names.add(name)
        used.add(part)
        sheet = read_xml(parts, part, SHEET, "worksheet")
        if sheet.omitted:
            book.omitted.append(P_SHEET.format(name))
        cells, serials = _sheet_cells(book, sheet, room)
        merged = sheet.first("mergeCells", SHEET)
        if serials:
            more = W_MORE.format(len(serials) - 5) if len(serials) > 5 else ""
            warnings.append(W_SERIAL.format(name, "、".join(serials[:5]), more, book.dates))
        if any(c["formula"] is not None and c["value"] is None for c in cells):
            warnings.append(W_NO_RESULT.format(name))
        if any(c["formulaKind"] in ("shared", "array") for c in cells):
            warnings.append(W_SHARED.format(name))
        if any("_xlfn." in (c["formula"] or "") for c in cells):
            warnings.append(W_PREFIX.format(name))
        sheets.append({"name": name, "part": part, "state": s.get("state") or "visible", "cells": cells, "merges": [m.get("ref") for m in (merged.all("mergeCell", SHEET) if merged else ())]})
    if not sheets:
        raise _bad("no worksheet")
    if book.omitted:
        warnings.append(W_OMITTED_PARTS.format("、".join(dict.fromkeys(book.omitted))))
    return {"schemaVersion": 1, "format": "xlsx", "warnings": warnings, "dateSystem": book.dates, "sheets": sheets}


# --- entry points ------------------------------------------------------------------------


def to_json(value: Any) -> str:
    """The one text of a result: insertion order, no spaces, lone surrogates escaped."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def parse_office(content: bytes, form: str) -> dict[str, Any]:
    if form not in MAIN_TYPES:
        raise ParseError("unsupported", f"not a supported format: {form}")
    try:
        parts = read_package(content)
        main = main_part(parts, form)
        result = parse_word(parts, main) if form == "docx" else parse_workbook(parts, main)
        if len(to_json(result).encode()) > LIMITS["outputBytes"]:
            raise _over("outputBytes")
        return result
    except ParseError:
        raise
    except Exception as error:  # noqa: BLE001  a broken package can break any reader in any way
        raise ParseError("invalid_document", f"the package can't be read: {type(error).__name__}") from error


def parse_in_child(content: bytes, form: str) -> dict[str, Any]:
    """As ``parse_office``, in a process of its own with a time limit and a memory limit."""
    try:
        done = subprocess.run([sys.executable, "-m", "tessera.sources.office", form], input=content, capture_output=True, timeout=LIMITS["timeoutMs"] / 1000)
    except subprocess.TimeoutExpired:
        raise ParseError("timeout", "parsing took too long") from None
    try:
        answer = json.loads(done.stdout)
    except ValueError:
        raise ParseError("parser_crashed", "the parser ended without an answer") from None
    if "error" in answer:
        raise ParseError(answer["error"], answer["message"])
    return answer["result"]


def parser_config(form: str) -> dict[str, Any]:
    return {"schema": 1, **LIMITS, "format": form}


def parser_config_hash(form: str) -> str:
    return canonical_config_hash(parser_config(form))


RESULT = "struct<status:string,error:string,message:string,content:string>"


def parsed_column(content: Column, form: Column, *, isolated: bool = False) -> Column:
    """``ready`` with the result's JSON, ``unsupported``, or ``failed`` with an error kind and a message. Null contents fail."""

    def run(contents: pa.Array, forms: pa.Array) -> pa.Array:
        rows = []
        for data, name in zip(contents.to_pylist(), forms.to_pylist()):
            if name not in MAIN_TYPES:
                rows.append({"status": "unsupported", "error": None, "message": None, "content": None})
                continue
            try:
                parsed = (parse_in_child if isolated else parse_office)(data or b"", name)
                rows.append({"status": "ready", "error": None, "message": None, "content": to_json(parsed)})
            except ParseError as e:
                rows.append({"status": "failed", "error": e.code, "message": str(e), "content": None})
        return pa.array(rows, pa.struct([(n, pa.string()) for n in ("status", "error", "message", "content")]))

    run.__annotations__ = {"contents": pa.Array, "forms": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(content, form)


_CELL = "struct<location:string,text:string,columnSpan:int,verticalMerge:string>"
_SHEET_CELL = "struct<address:string,row:int,column:int,value:string,valueType:string,formula:string,formulaKind:string,numberFormat:string,hiddenRow:boolean,hiddenColumn:boolean>"
PARSED_SCHEMA = (
    f"schemaVersion int, format string, warnings array<string>, dateSystem string, blocks array<struct<kind:string,location:string,text:string,style:string,rows:array<array<{_CELL}>>>>, "
    f"sheets array<struct<name:string,part:string,state:string,cells:array<{_SHEET_CELL}>,merges:array<string>>>"
)


def cells_of(parsed: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row a stored sheet cell: ``key``, sheet, sheet_index, and the cell's fields."""
    rows = parsed.select(key, F.from_json(content, PARSED_SCHEMA).alias("p")).select(key, F.posexplode("p.sheets").alias("sheet_index", "s"))
    return rows.select(key, "sheet_index", F.col("s.name").alias("sheet"), F.explode("s.cells").alias("c")).select(key, "sheet_index", "sheet", "c.*")


def blocks_of(parsed: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row a Word block: ``key``, index, kind, location, text, style, rows."""
    rows = parsed.select(key, F.from_json(content, PARSED_SCHEMA).alias("p")).select(key, F.posexplode("p.blocks").alias("index", "b"))
    return rows.select(key, "index", "b.*")


def _child(form: str) -> None:
    import resource

    resource.setrlimit(resource.RLIMIT_AS, (MEMORY_BYTES, MEMORY_BYTES))
    try:
        answer: dict[str, Any] = {"result": parse_office(sys.stdin.buffer.read(), form)}
    except ParseError as e:
        answer = {"error": e.code, "message": str(e)}
    sys.stdout.write(json.dumps(answer))


if __name__ == "__main__":
    _child(sys.argv[1])
