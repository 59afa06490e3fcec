import duckdb
import pytest

import __spark_entry__
from lectern.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = __spark_entry__.queries()["op1_language_id"](spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang, text FROM '{SF}/documents.parquet'").df()
    both = out.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(out) == len(truth)
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()
    assert both.accepted.mean() > 0.97


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog went home " * 8 + str(i), "en") for i in range(20)] + [("der hund und die katze gehen nach haus " * 8 + str(i), "de") for i in range(10)]
    return langid.fit(spark.createDataFrame([*rows, (None, "fr"), ("no label", None), ("12 34", "xx")], "text string, lang string"))


def test_brute_force_smallest_encoding(model):
    coder = langid.Coder(model)
    for text in ("the dog and the cat", "die katze und der hund", "Der Hund", "THE CAT"):
        sizes = dict(zip(coder.langs, coder.sizes(text.casefold().encode()), strict=True))
        lang, margin = coder.predict(text)
        assert sizes[lang] == min(sizes.values()) and 0 <= margin <= 1


def test_edges(spark, model):
    assert set(model.dictionaries) == {"en", "de"}
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (4, "the cat " * 50_000, "a"), (5, "der hund und die katze", "a")]
    out = {r.doc_id: r for r in langid.classify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not any(out[i].accepted for i in (1, 2, 3))
    assert (out[4].lang_pred, out[5].lang_pred) == ("en", "de")


def test_nothing_learned(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert langid.classify(spark.createDataFrame([("x y",)], "text string"), model).first().lang_pred == "und"


def test_languages_of_copies_keep_their_texts(spark):
    few = [f"der hund nummer {'x' * (i + 1)} und die katze gehen nach haus" for i in range(20)]
    one, two = spark.range(60_000).selectExpr("'the cat and the dog went home' AS text", "'en' AS lang"), spark.createDataFrame([(t, "de") for t in few], "text string, lang string")
    model = langid.fit(one.union(two.crossJoin(spark.range(3_000)).select("text", "lang")))
    assert model.dictionaries["en"].decode() == "the cat and the dog went home"
    assert sorted(model.dictionaries["de"].decode().split("\n")) == sorted(few)
    assert model.rows == {"en": 60_000, "de": 60_000}
