"""Crawl states and archived pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(articles: DataFrame, retry: bool, most_attempts: int, limit: int | None = None) -> DataFrame:
    """Pending articles, with ``retry`` also failed and partial ones with attempts left; by date, then url."""
    states = ["pending", "error", "partial"] if retry else ["pending"]
    found = articles.where(F.col("status").isin(*states)).where((F.col("status") == "pending") | (F.col("attempts") < most_attempts)).orderBy("catalog_date", "url")
    return found if limit is None else found.limit(limit)


def action_state(articles: DataFrame, most_attempts: int) -> DataFrame:
    """One row: counts by state, what can still be acted on, what is final, and whether errors should be retried now."""
    state, tries = F.col("status"), F.coalesce(F.col("attempts"), F.lit(0)) < most_attempts
    again = state.isin("error", "partial") & tries
    waiting = F.count_if(state == "pending")
    return articles.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "complete").alias("complete"), waiting.alias("pending"), F.count_if(again).alias("recoverable"),
        F.count_if(state.isin("error", "partial") & ~tries).alias("terminal"),
        F.when(waiting > 0, waiting).otherwise(F.count_if(again)).alias("actionable"), ((waiting == 0) & (F.count_if(again) > 0)).alias("retry_errors"),
    )


def status_summary(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))


def completion(body_chars: Column, image_status: Column, least: int = 200) -> Column:
    """complete if the body is long enough and no image is wanting, else partial."""
    return F.when((F.coalesce(body_chars, F.lit(0)) >= least) & image_status.isin("complete", "none", "skipped"), "complete").otherwise("partial")


def image_status(references: Column, downloaded: Column) -> Column:
    return F.when(F.coalesce(references, F.lit(0)) == 0, "none").when(downloaded >= references, "complete").when(downloaded > 0, "partial").otherwise("missing")


def best_variant(candidates: DataFrame, family: str, order: list[str]) -> DataFrame:
    """Per family the candidate that is greatest by ``order`` (say class, then area), of equal ones the least url."""
    rest = [c for c in candidates.columns if c != family]
    return candidates.groupBy(family).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b")).select(family, *[F.col(f"b.{c}").alias(c) for c in rest])


def families(variants: DataFrame, family: Column) -> DataFrame:
    """(family, key, urls): variants by family, the key its SHA-256, urls sorted."""
    return variants.groupBy(family.alias("family")).agg(F.array_sort(F.collect_set("url")).alias("urls")).withColumn("key", F.sha2("family", 256))


def recover(states: DataFrame) -> DataFrame:
    """States after a restart: what was downloading is pending again."""
    return states.withColumn("status", F.when(F.col("status") == "downloading", "pending").otherwise(F.col("status")))


def longest_suffix(hosts: DataFrame, zones: DataFrame) -> DataFrame:
    """Each host with the longest zone that it is or ends with (after a dot). The host's own suffixes are the join keys."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("*", F.explode(suffixes).alias("zone")).join(zones.select("zone").distinct(), "zone")
    best = each.groupBy(*hosts.columns).agg(F.max_by("zone", F.length("zone")).alias("zone"))
    return best
