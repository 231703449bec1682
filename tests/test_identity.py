import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity as i
from tessera.operators import normalize

VECTORS = [
    ({}, "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"),
    ({"a": 1}, "015abd7f5cc57a2dd94b7590f04ad8084273905ee33ec5cebeae62276a97f862"),
    ({"b": 2, "a": 1}, "43258cff783fe7036d8a43033f830adfc60ec037382473548ac742b888292777"),
    ({"a": None}, "d091f9c83c091f79652fe8786375b3fe4ce0861a56f5bfbafedbe431877ff0e8"),
    ({"a": "café"}, "e3c598cda7afb08d1ddede0a770feb8db4312dece093d15449a1856192c34a2f"),
    ({"a": "café"}, "e3c598cda7afb08d1ddede0a770feb8db4312dece093d15449a1856192c34a2f"),
    ({"a": [1, 2]}, "01530d164d479cf08e26d3b1ad9bdba927120d97e2d057a6d792db778780d720"),
    ({"a": [2, 1]}, "439e3fbf35fa867d156db2626f94efbd435852a97bbe16660ee529d9bda0e502"),
    ({"a": "日本語"}, "b019077fad3f09225e38f194c05edf83cd5a5a504fa04c55b9ac1f4a78fa2707"),
]


@pytest.mark.parametrize("config,expected", VECTORS)
def test_config_hash_vectors(config, expected):
    assert i.canonical_config_hash(config) == expected


def test_config_hash_rules():
    assert i.canonical_config_hash({"a": 1.0}) == i.canonical_config_hash({"a": 1})
    assert i.canonical_json({"a": -0.0, "b": i.UNDEFINED}) == '{"a":0}'
    for bad in (1.5, float("nan"), 2**53, {"a": [i.UNDEFINED]}, {"café": 1, "café": 2}, {1, 2}):
        with pytest.raises(ValueError):
            i.canonical_config_hash({"x": bad} if not isinstance(bad, dict) else bad)
    assert normalize.config_hash() == "ed2ad18f2abb020721c4090870381bdc8e13c3badff5b617a7cf7baf70db0945"


def test_outputs_hash_vectors():
    assert i.py_outputs_hash([]) == "7d33c9d029ac7d770c5ede79a2ae0989c9df1bd8b8ce5784e61ad7a8f0317ebe"
    assert i.py_outputs_hash([(0, "a", "bc"), (1, "d", "e")]) == "86268c9c541bca3aa1275b1ba7deea5b0023d8211d3a76a1482625aa22354c5a"
    assert i.py_outputs_hash([(1, "cd", "e"), (0, "a", "b")]) == "bfe2d83cab3d13025cd44b53b68ca22450755aa73993e58bc19a7c26db3ea0ed"
    with pytest.raises(ValueError):
        i.py_outputs_hash([(1, "a", "b")])


def test_columns_equal_their_twins(spark):
    rows = [("s", "a/b.txt", "0a", ["b", "a"], 3), ("sé", "日本/語", "ff", ["x"], 0)]
    df = spark.createDataFrame(rows, "s string, k string, h string, ids array<string>, n bigint")
    got = df.select(i.document_id("s", "k"), i.version_id("k", "h"), i.derivation_key("s", "k", "h", "ids"), i.artifact_id("k", "n"), i.blob_path("r", F.sha2("k", 256))).collect()
    for (s, k, h, ids, n), r in zip(rows, got):
        digest = hashlib.sha256(k.encode()).hexdigest()
        assert list(r) == [i.py_document_id(s, k), i.py_version_id(k, h), i.py_derivation_key(s, k, h, ids), i.py_artifact_id(k, n), f"r/{digest[:2]}/{digest[2:]}"]


def test_columns_refuse_what_is_malformed(spark):
    df = spark.createDataFrame([("Z", ["a", "a"], -1)], "h string, ids array<string>, n bigint")
    for bad in (i.version_id(F.lit("d"), "h"), i.derivation_key(F.lit("a"), F.lit("b"), F.lit("c"), "ids"), i.artifact_id(F.lit("k"), "n"), i.epoch_ms(F.lit(1.5))):
        with pytest.raises(Exception):
            df.select(bad).collect()


def test_outputs_hash_column_and_order(spark):
    df = spark.createDataFrame([([(1, "d", "e"), (0, "a", "bc")],), ([],), ([(0, "a", "b"), (2, "c", "d")],)], "o array<struct<ordinal:bigint,artifact_id:string,content_hash:string>>")
    got = df.select(i.outputs_hash("o"), i.contiguous("o")).collect()
    assert got[0][0] == "86268c9c541bca3aa1275b1ba7deea5b0023d8211d3a76a1482625aa22354c5a"
    assert got[1][0] == "7d33c9d029ac7d770c5ede79a2ae0989c9df1bd8b8ce5784e61ad7a8f0317ebe"
    assert [r[1] for r in got] == [True, True, False]
