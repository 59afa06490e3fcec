import hashlib

import corpus_pipeline
from tests.llm.test_linededup import brute as lines_left
from tests.llm.test_ngramjoin import shingles

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_on_given_documents(spark, tmp_path):
    docs = corpus_pipeline.documents(spark, SF)
    before = rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = rows(out)
        assert set(after) <= set(before) and len(after) == out.count(), name
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        if k == 0:
            assert len(after) >= 0.97 * len(before)
        if k == 1:
            assert sorted((str(i), r.text) for i, r in after.items()) == lines_left([(i, r.text) for i, r in before.items()])
        if k == 2:
            sets = {i: shingles(r.text, 5) for i, r in before.items()}
            ids, near = sorted(before), lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            root = {i: i for i in ids}
            for i in ids:
                for j in ids:
                    if j < i and near(sets[i], sets[j]):
                        a, b = root[i], root[j]
                        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
            assert set(after) == set(root.values())
        if k == 3:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in after.values() for i in items)
        if k == 4:
            for i, r in after.items():
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
        docs, before = out, after


def test_edges(spark):
    text = "the cat and the dog went home to see the other cat " * 3
    some = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "de", "s", 0), (None, text + "x", None, "s", 1), (5, "der hund und die katze gehen nach haus " * 5, "de", "s", 1)]
    for data in (some, []):
        docs = spark.createDataFrame(data, COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        out = docs.collect()
        assert [r.doc_id for r in sorted(out, key=lambda r: r.doc_id)] == ([1, 5] if data else [])


def test_clashing_columns(spark):
    """Columns of names that the stages use themselves stay as they are until the last stage."""
    extra = ["_uid", "uid", "row", "lines", "places", "told", "lang_pred", "score", "accepted", "n_lines", "n_removed", "component_id", "item_id", "distance"]
    rows = [(i, f"the cat number {i} and the dog went home to see the other {i} cats " * 3, "en", "s", 5, *range(len(extra))) for i in range(4)]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, {', '.join(f'{c} long' for c in extra)}")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == extra
    assert all(list(r)[5:] == list(range(len(extra))) for r in docs.collect()) and docs.count() == 4
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 4
