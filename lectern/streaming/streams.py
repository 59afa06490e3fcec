"""Structured Streaming twins of batch operators; each gives what its batch form gives once all input is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What each event makes of a crawl record; attempts grow with a start.
TRANSITIONS = {"start": "downloading", "complete": "complete", "partial": "partial", "fail": "error", "restart": "pending"}


def once(stream: DataFrame, key: str, time: str, keep: str) -> DataFrame:
    """Each key's first row within ``keep``; later ones in that time are dropped, state older than it is forgotten."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; on a stream a window closes when the watermark passes it."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    found = source.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), kind, "n", "total")


def crawl_states_batch(events: DataFrame) -> DataFrame:
    """(url, status, attempts) after events(url, seq, event); a restart resets only what was downloading."""
    ordered = events.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("es"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"))

    def step(acc, e):
        to = acc["status"]
        for name, state in TRANSITIONS.items():
            fits = (e["event"] == name) & ((F.lit(name) != "restart") | (acc["status"] == "downloading"))
            to = F.when(fits, F.lit(state)).otherwise(to)
        return F.struct(to.alias("status"), (acc["attempts"] + F.when(e["event"] == "start", 1).otherwise(0)).alias("attempts"))

    return ordered.select("url", F.aggregate("es", start, step).alias("s")).select("url", "s.status", "s.attempts")


def fold_frames(frames: DataFrame) -> DataFrame:
    """Per conversation its text, references (each once) and how it ended, from frames(conv, seq, type, text, ref)."""
    text = F.array_join(F.transform(F.filter("fs", lambda f: f["type"] == "text_delta"), lambda f: f["text"]), "")
    refs = F.array_distinct(F.filter(F.transform("fs", lambda f: f["ref"]), lambda x: x.isNotNull()))
    held = frames.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "text", "ref"))).alias("fs"))
    ends = F.transform(F.filter("fs", lambda f: f["type"].isin("done", "error")), lambda f: f["type"])
    return held.select("conv", text.alias("text"), refs.alias("refs"), F.coalesce(F.try_element_at(ends, F.lit(1)), F.lit("open")).alias("end"))


def last_lines(log: DataFrame, job: str, order: str, keep: int = 500) -> DataFrame:
    """The last ``keep`` lines of each job."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: none is running any more."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def drained(stream: DataFrame, spark: SparkSession, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and gives its rows (a memory table: for tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
