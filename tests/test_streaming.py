from pyspark.sql import functions as F

from lectern.streaming import streams

SCHEMA = "url string, seq long, event string, at timestamp"
ROWS = [("u", 1, "start"), ("u", 2, "restart"), ("u", 3, "start"), ("u", 4, "complete"), ("u", 5, "restart"), ("v", 1, "start"), ("v", 2, "fail")]


def written(spark, tmp_path):
    df = spark.createDataFrame([(u, s, e) for u, s, e in ROWS], "url string, seq long, event string").withColumn("at", F.timestamp_seconds(F.col("seq") * 60))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_crawl_states(spark, tmp_path):
    batch, _ = written(spark, tmp_path)
    want = {r.url: (r.status, r.attempts) for r in streams.crawl_states_batch(batch).collect()}
    assert want == {"u": ("complete", 2), "v": ("error", 1)}


def test_once(spark, tmp_path):
    _, stream = written(spark, tmp_path)
    got = streams.drained(streams.once(stream, "url", "at", "1 hour"), spark, "once", "append", str(tmp_path / "c2"))
    assert sorted(r.url for r in got.collect()) == ["u", "v"]


def test_windowed_counts(spark, tmp_path):
    batch, stream = written(spark, tmp_path)
    want = {(r.event, r.n) for r in streams.windowed_counts(batch.where("event <> ''"), "at", "event", "seq").collect()}
    got = streams.drained(streams.windowed_counts(stream, "at", "event", "seq"), spark, "counts", "complete", str(tmp_path / "c3"))
    assert {(r.event, r.n) for r in got.collect()} == want


def test_frames(spark):
    rows = [("c", 2, "text_delta", "b", None), ("c", 1, "text_delta", "a", None), ("c", 3, "tool_end", None, "r1"), ("c", 4, "tool_end", None, "r1"), ("c", 5, "done", None, None), ("d", 1, "text_delta", "x", None)]
    out = {r.conv: r for r in streams.fold_frames(spark.createDataFrame(rows, "conv string, seq int, type string, text string, ref string")).collect()}
    assert (out["c"].text, out["c"].refs, out["c"].end) == ("ab", ["r1"], "done") and out["d"].end == "open"

