"""Queries of streams with state, as streams over the whole table and as their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.registry import Registry, table
from lectern.session import shared_folder
from lectern.streaming import stateful, streams

#: Rounds of the fan-in: a desk asks its five sources every hour and waits for twenty minutes.
_FAN_IN = """
WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS desk, date_trunc('hour', ts) AS started, CAST(user_id AS VARCHAR) AS source, ts AS came_at, event_type <> 'error' AS ok, CAST(event_id % 50 AS VARCHAR) AS id, date_trunc('minute', ts) AS published FROM events),
r AS (SELECT desk, started, CAST(epoch(started) // 3600 AS BIGINT) AS round FROM (SELECT DISTINCT desk, started FROM e)),
c AS (SELECT e.*, r.round FROM e JOIN r USING (desk, started) WHERE came_at <= started + INTERVAL 20 MINUTE),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY desk, round, source ORDER BY came_at, ok) = 1),
t AS (SELECT desk, round, CAST(count(*) AS INT) AS came, CAST(count(*) FILTER (ok) AS INT) AS ok, max(came_at) AS last FROM f GROUP BY 1, 2),
i AS (SELECT * FROM f WHERE ok QUALIFY row_number() OVER (PARTITION BY desk, round, id ORDER BY came_at DESC, source DESC) = 1),
o AS (SELECT desk, round, string_agg(id || '@' || strftime(published, '%H:%M'), ',' ORDER BY published DESC, id) AS own FROM i GROUP BY 1, 2),
a AS (SELECT r.desk, r.round, r.started, coalesce(came, 0) AS came, coalesce(ok, 0) AS ok, last, own FROM r LEFT JOIN t USING (desk, round) LEFT JOIN o USING (desk, round)),
z AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY desk ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS items, CASE WHEN came >= 2 THEN last ELSE started + INTERVAL 20 MINUTE END AS closed FROM a)
SELECT desk, round, CASE WHEN ok > 0 THEN CASE WHEN came >= 2 THEN 'complete' ELSE 'partial' END WHEN items IS NULL THEN 'unavailable' ELSE 'stale' END AS status, came, ok, closed,
CASE WHEN ok > 0 THEN closed + INTERVAL 300 SECOND WHEN items IS NOT NULL THEN closed + INTERVAL 60 SECOND END AS served_until, items FROM z
"""


def _responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    started = F.date_trunc("hour", "ts").cast("timestamp")
    item = F.struct((F.col("event_id") % 50).cast("string").alias("id"), F.date_trunc("minute", "ts").cast("timestamp").alias("published"), F.col("event_type").alias("body"))
    return e.select(
        (F.col("user_id") % 20).cast("string").alias("desk"), F.expr("unix_timestamp(date_trunc('hour', ts)) div 3600").alias("round"), started.alias("started"), F.lit(2).alias("expected"),
        F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.array(item).alias("items"),
    )


def _shown(rounds):
    items = F.array_join(F.transform("items", lambda i: F.concat(i["id"], F.lit("@"), F.date_format(i["published"], "HH:mm"))), ",")
    return rounds.select("desk", "round", "status", "came", "ok", F.col("closed").cast("timestamp_ntz").alias("closed"), F.col("served_until").cast("timestamp_ntz").alias("served_until"), items.alias("items"))


def _events(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in ("start", "complete", "partial", "fail", "restart")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), name.alias("event"), F.col("ts").cast("timestamp").alias("at"))


def _streamed(spark, rows, make, name, mode, last=None):
    """``make`` over a stream of ``rows``, which come from files in several batches; ``last``: a row that moves the watermark to the end."""
    folder = shared_folder(spark, name)
    rows.write.parquet(f"{folder}/in")
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stateful.with_rocksdb(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    out = make(stream)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def register(r: Registry) -> None:
    @r.query("fan_in_rounds", _FAN_IN)
    def fan_in_rounds(spark, sf_dir):
        return _shown(stateful.fan_in_batch(_responses(spark, sf_dir), "20 minutes"))

    @r.query("fan_in_stream", _FAN_IN)
    def fan_in_stream(spark, sf_dir):
        rows = _responses(spark, sf_dir)
        # a year later each desk opens a round that is not closed within the stream
        end = rows.select("desk").distinct().select(
            "desk", F.lit(10**9).alias("round"), F.lit("2030-01-01").cast("timestamp").alias("started"), F.lit(1).alias("expected"), F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast(rows.schema["items"].dataType).alias("items"),
        )
        return _shown(_streamed(spark, rows, lambda s: stateful.fan_in_stream(s, "20 minutes", late="40 days"), "fan_in", "append", end))

    @r.query(
        "once_in_time",
        "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1",
    )
    def once_in_time(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at")).coalesce(1).sortWithinPartitions("event_id")
        return _streamed(spark, rows, lambda s: streams.once(s, "user_id", "at", "400 days"), "once", "append").select("user_id", "event_id")
