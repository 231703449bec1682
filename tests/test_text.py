import random

from pyspark.sql import functions as F

from tessera.functions import text as t


def test_fold_vectors():
    assert t.py_fold("　Ａ①\r\nＢ C　") == "a1 b c"
    assert t.py_fold("a​b") == "a​b"
    assert t.py_fold("İ") == "i̇"


def test_normalize_key(spark):
    rows = [("\\a\\b/", "NFC", False, "posix", True), ("/Café/", "NFC", True, "posix", True), ("Café", "NFD", False, "as-is", False), ("a\\b/", "none", False, "as-is", False), (None, "NFC", True, "posix", True)]
    df = spark.createDataFrame(rows, "k string, f string, c boolean, s string, tr boolean")
    got = [r[0] for r in df.select(t.normalize_key("k", "f", "c", "s", "tr")).collect()]
    assert got == ["a/b", "café", "Café", "a\\b/", None]
    assert got[:4] == [t.py_normalize_key(*r) for r in rows[:4]]


def test_addresses_round_trip(spark):
    rng = random.Random(4)
    pairs = [(1, 1), (1048576, 16384), (7, 26), (8, 27), (9, 702), (10, 703)] + [(rng.randint(1, 1048576), rng.randint(1, 16384)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "r int, c int").withColumn("a", t.cell_address("r", "c"))
    for r in df.select("r", "c", "a", t.address_row("a").alias("r2"), t.address_column("a").alias("c2")).collect():
        assert (r.r, r.c) == (r.r2, r.c2) == t.py_coordinates(r.a)
    bad = spark.createDataFrame([("XFE1",), ("A0",), ("a1",), ("A1048577",), ("",), ("AAAA1",)], "a string")
    assert all(r[0] is None and r[1] is None for r in bad.select(t.address_row("a"), t.address_column("a")).collect())


def test_rows_without_end(spark):
    pairs = [(1, 1), (1048577, 26), (9999999, 703), (2147483648, 16384), (2**63 - 1, 27)]
    df = spark.createDataFrame(pairs, "r bigint, c int").withColumn("a", t.cell_address("r", "c", last_row=None))
    got = df.select("r", "c", t.address_row("a", last_row=None), t.address_column("a", last_row=None), t.cell_address("r", "c"), t.address_row("a")).collect()
    assert all(tuple(r)[:2] == tuple(r)[2:4] for r in got)
    assert [tuple(r)[4:] for r in got] == [("A1", 1)] + [(None, None)] * 4  # a sheet still ends
    bad = spark.createDataFrame([("XFE1",), ("A0",), ("a1",), ("A9223372036854775808",), ("",), ("AAAA1",)], "a string")
    assert all(r[0] is None and r[1] is None for r in bad.select(t.address_row("a", last_row=None), t.address_column("a", last_row=None)).collect())
    out = spark.createDataFrame([(0, 1), (1, 0), (1, 16385), (-5, 1)], "r bigint, c int")
    assert all(r[0] is None for r in out.select(t.cell_address("r", "c", last_row=None)).collect())


def test_excel_dates(spark):
    cases = [
        ("1", "yyyy-mm-dd", "1900", "1900-01-01"), ("59", "yyyy-mm-dd", "1900", "1900-02-28"), ("60", "yyyy-mm-dd", "1900", t.ONLY_IN_EXCEL), ("61", "yyyy-mm-dd", "1900", "1900-03-01"),
        ("46284", "yyyy-mm-dd", "1900", "2026-09-19"), ("46284.57291666666", "yyyy-mm-dd hh:mm", "1900", "2026-09-19 13:45:00"), ("0.001", "mm:ss", "1900", "00:01:26"), ("0", "yyyy-mm-dd", "1904", "1904-01-01"),
        ("0", "yyyy-mm-dd", "1900", ""), ("x", "yyyy", "1900", ""), ("-1", "yyyy", "1900", ""), ("2958466", "yyyy", "1900", ""), ("5", "0.00", "1900", ""), ("1", "組み込み書式 30（x）", "1900", "1900-01-01"), ("1", "組み込み書式 42", "1900", ""),
    ]
    df = spark.createDataFrame([(*c,) for c in cases], "v string, f string, s string, want string")
    for r in df.select("v", "f", t.excel_date("v", F.lit("n"), "f", "s").alias("got"), "want").collect():
        assert r.got == r.want, r
    assert df.select(t.excel_date("v", F.lit("s"), "f", "s").alias("x")).where("x <> ''").count() == 0


def test_date_formats(spark):
    cases = {"yyyy": True, "0.00": False, '"day"0': False, "[Red]0": False, "\\d0": False, "h:mm": True, "General": False}
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    got = {r[0]: r[1] for r in df.select("f", t.is_date_format("f")).collect()}
    assert got == {k: t.py_is_date_format(k) for k in cases} == cases


def test_names_and_patterns(spark):
    df = spark.createDataFrame([("a/b/C.DOCX",), (".hidden",), ("x",)], "k string")
    assert [tuple(r) for r in df.select(t.basename("k"), t.extension("k")).collect()] == [("C.DOCX", "docx"), (".hidden", ""), ("x", "")]
    assert t.like_pattern("50%_!") == "%50!%!_!!%"
