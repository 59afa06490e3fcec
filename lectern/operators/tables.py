"""Small relational steps that several surfaces share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """``previous`` and ``next`` keys in order within the group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def toc_page(rows: DataFrame, group: str, order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """``limit`` (1 to 200) rows of each group from ``offset``, with ``has_more``."""
    limit = min(max(limit, 1), 200)
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return placed.where((F.col("_i") >= offset) & (F.col("_i") < offset + limit)).join(totals, group).withColumn("has_more", F.col("_n") > offset + limit).drop("_i", "_n")


def page_numbers(pages: DataFrame, current: str, last: str, around: int = 2) -> DataFrame:
    """(…, shown): the first, the last and those around the current page as text, each gap as one …."""
    near = F.filter(F.sequence(F.lit(1), F.col(last)), lambda p: (p == 1) | (p == F.col(last)) | (F.abs(p - F.col(current)) <= around))
    told = F.transform(near, lambda p, i: F.when((i > 0) & (p - F.get(near, i - 1) > 1), F.concat(F.lit("… "), p.cast("string"))).otherwise(p.cast("string")))
    return pages.withColumn("shown", F.array_join(told, " "))


def search_people(people: DataFrame, query: str, name: str, email: str, key: str) -> DataFrame:
    """People whose name or e-mail holds the query in any case, or whose id it is; nobody for under two characters."""
    q = query.strip()
    if len(q) < 2:
        return people.limit(0)
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return people.where(has(name) | has(email) | (F.col(key).cast("string") == q))


def not_done(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose whole key isn't among the done ones."""
    return items.join(done.select(*keys), keys, "left_anti")


def running(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``total``: the sum of a value up to each row."""
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def recent_items(visits: DataFrame, user: str, item: str, at: list[str], keep: int = 8) -> DataFrame:
    """Each user's last ``keep`` items by their latest visit, with progress within 0 to 100."""
    latest = visits.groupBy(user, item).agg(F.max_by(F.struct("progress", *at), F.struct(*at)).alias("v")).select(user, item, "v.*")
    placed = latest.withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(*[F.desc(a) for a in at], item)))
    return placed.where(F.col("_n") <= keep).withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress")))).drop("_n", *at)


def anchor(notes: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """``start`` of each note's quote in its section's text: its own offset if the quote is there, else the one place
    where prefix, quote and suffix stand; null if there is none or several.

    notes(key, start_offset, prefix, quote, suffix), sections(key, text). Offsets begin at 0.
    """
    both = notes.join(sections.select(key, "text"), key, "left")
    here = F.substring(F.col("text"), F.col("start_offset") + 1, F.length("quote")) == F.col("quote")
    whole = F.concat(F.coalesce("prefix", F.lit("")), F.col("quote"), F.coalesce("suffix", F.lit("")))
    first = F.position(whole, F.col("text"))
    again = F.position(whole, F.col("text"), first + 1)
    found = F.when((first > 0) & (again == 0), first - 1 + F.length(F.coalesce("prefix", F.lit(""))))
    return both.withColumn("start", F.when(F.coalesce(here, F.lit(False)), F.col("start_offset")).otherwise(found)).drop("text")


def clean_document(df: DataFrame, fields: tuple[str, ...] = ("title", "content", "date", "page", "source")) -> Column:
    """The named fields as JSON; null and empty ones are left out."""
    kept = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields if c in df.columns]
    return F.to_json(F.struct(*kept))
