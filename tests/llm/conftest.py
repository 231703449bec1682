import pytest

#: Every operator meets these: nulls in any column, empty and very long texts, ties, repeated rows, names that clash.
ODD_TEXTS = [None, "", " \t\n", "x", "ü ß ñ", "word " * 30_000, "a b c d e f g h i j", "a b c d e f g h i j"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None if k == 2 else 5, "clash") for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here at all", None, None, None, None), (3, "x", "en", None, 1, "clash")]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return lambda extra: spark.createDataFrame(rows, f"{names}, `{extra}` string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
