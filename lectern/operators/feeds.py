"""Feeds: balancing over sources, coverage summaries, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced(items: DataFrame, source: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` items: of each source first its newest max(1, limit // sources), then the newest of the rest.

    ``order`` must be total. The number of sources is a one-row aggregate joined on, so all is one plan.
    """
    sources = items.agg(F.countDistinct(source).alias("_n"))
    quota = F.greatest(F.lit(1), F.expr(f"{limit} DIV greatest(_n, 1)"))
    ranked = items.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_rn") <= limit)
    marked = ranked.crossJoin(F.broadcast(sources)).withColumn("_late", F.col("_rn") > quota).drop("_rn", "_n")
    return marked.orderBy("_late", *order).limit(limit).drop("_late").orderBy(*order)


def last_by_key(items: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``."""
    rest = [c for c in items.columns if c != key]
    best = items.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def local_day(ts: Column, zone: str) -> Column:
    """The calendar date of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_bucket(ts: Column, now: Column, zone: str) -> Column:
    """today, yesterday, older, future or undated, by calendar dates in the zone."""
    days = F.datediff(local_day(now, zone), local_day(ts, zone))
    return F.when(ts.isNull(), "undated").when(days == 0, "today").when(days == 1, "yesterday").when(days < 0, "future").otherwise("older")


def coverage(entries: DataFrame, publisher: str, now: Column, zone: str) -> DataFrame:
    """Per publisher: counts by day bucket, distinct urls, shares of entries with any and with 1,000 characters, median length.

    entries(publisher, url, published, chars). Shares are rounded half-even to three places.
    """
    b = entries.withColumn("_b", day_bucket(F.col("published"), now, zone))
    n = F.count(F.lit(1))
    return b.groupBy(publisher).agg(
        n.alias("item_count"), F.countDistinct("url").alias("urls"),
        *[F.count_if(F.col("_b") == k).alias(k) for k in ("today", "yesterday", "older", "future", "undated")],
        F.bround(F.count_if(F.col("chars") > 0) / n, 3).alias("nonempty_rate"), F.bround(F.count_if(F.col("chars") >= 1000) / n, 3).alias("long_rate"),
        F.bround(F.median("chars")).cast("bigint").alias("median_chars"), F.max("published").alias("latest"),
    )


def rollup(results: DataFrame) -> DataFrame:
    """One row over all publishers(status, today, yesterday): rates over all, sums over those that answered."""
    ok, n = F.col("status") == "ok", F.count(F.lit(1))
    rate = lambda c: F.when(n > 0, F.bround(F.count_if(c) / n, 3))
    return results.agg(
        n.alias("publishers"), F.count_if(ok).alias("available"), rate(ok).alias("available_rate"),
        F.count_if(ok & (F.col("today") > 0)).alias("with_today"), F.coalesce(F.sum(F.when(ok, F.col("today") + F.col("yesterday"))), F.lit(0)).alias("recent_items"),
    )


def probe_status(http_status: Column, size: Column, body: Column, most: int = 4_000_000) -> Column:
    """What a fetched feed is: request_error, http_error, too_large, html, invalid or ok."""
    head = F.lower(F.substring(F.ltrim(body), 1, 256))
    return (
        F.when(http_status.isNull(), "request_error").when((http_status < 200) | (http_status >= 300), "http_error").when(size > most, "too_large")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "html").when(head.rlike(r"<(rss|rdf|feed)[\s:>]"), "ok").otherwise("invalid")
    )


def round_robin(items: DataFrame, group: str, name: str) -> DataFrame:
    """Names one per group in turn: groups by SHA-256, within a group names by descending SHA-256."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.sha2(F.col(name), 256)), name))
    return items.withColumn("turn", turn.cast("bigint"))
