"""Letters and other symbols beyond U+FFFF."""

from tessera.llm import language_id


def test_symbols_beyond_the_table_are_no_letters(spark):
    texts = ["\U0001F600\U0001F680 \U0001F600", "\U00020000\U00020001", "abc \U0001F600 abc"]
    rows = [(k, "abc bcd cde", "en") for k in range(20)] + [(100 + k, t, None) for k, t in enumerate(texts)]
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id - 100: (r.lang_pred, r.score) for r in out.where("doc_id >= 100").collect()}
    assert got[0] == ("und", 0.0) and got[1][0] == "en" and got[2][0] == "en"
    assert [int(n) for n in language_id.Trigrams(texts).table().sum(axis=1)] == [0, 2, 6]
