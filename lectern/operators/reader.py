"""Reader data: explanations, threads, notifications, reports, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own_rows(df: DataFrame, viewer: str, column: str = "user_id", allowed: Column | None = None) -> DataFrame:
    """Rows that a viewer may see: their own, and only while ``allowed`` holds."""
    own = df.where(F.col(column) == viewer)
    return own if allowed is None else own.where(allowed)


def reusable_answer(df: DataFrame, quote: str, answer: str) -> DataFrame:
    """The most given non-null answer with its count and least quote; of equal counts the least answer."""
    found = df.where(F.col(answer).isNotNull()).groupBy(answer).agg(F.min(quote).alias("quote"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), answer).limit(1)


def popular_answers(df: DataFrame, phrase: str, answer: str, quote: str, least: int = 2, k: int = 50) -> DataFrame:
    """(phrase, answer) pairs given at least ``least`` times, the most given first."""
    found = df.where(F.col(answer).isNotNull()).groupBy(phrase, answer).agg(F.min(quote).alias("quote"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "quote", phrase, answer).limit(k)


def keyset_page(df: DataFrame, keys: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """Rows after ``cursor`` in descending order of ``keys``; a cursor names all keys or none."""
    if cursor is not None:
        if len(cursor) != len(keys) or any(c is None for c in cursor):
            raise ValueError("a cursor needs a value for each key")
        df = df.where(F.struct(*keys) < F.struct(*[F.lit(c).cast(df.schema[k].dataType).alias(k) for k, c in zip(keys, cursor, strict=True)]))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(min(max(size, 1), 100))


def threads(notes: DataFrame, comments: DataFrame, profiles: DataFrame, reported: DataFrame, default_name: str = "Reader") -> DataFrame:
    """Each note with its author's name and its comments in order, each with author's name and whether the viewer reported it.

    notes(note_id, user_id), comments(comment_id, note_id, user_id, at, body), profiles(user_id, name), reported(comment_id).
    """
    names = profiles.select("user_id", "name")
    mine = reported.select("comment_id").distinct().withColumn("_mine", F.lit(True))
    told = comments.join(names, "user_id", "left").join(mine, "comment_id", "left")
    entry = F.struct("at", "comment_id", F.coalesce("name", F.lit(default_name)).alias("name"), "body", F.coalesce("_mine", F.lit(False)).alias("reported"))
    nested = told.groupBy("note_id").agg(F.array_sort(F.collect_list(entry)).alias("comments"))
    return notes.join(names, "user_id", "left").withColumn("name", F.coalesce("name", F.lit(default_name))).join(nested, "note_id", "left")


def report_queue(reports: DataFrame, comments: DataFrame, notes: DataFrame) -> DataFrame:
    """Pending reports by comment: when the first came, how many, and all in order; oldest comment first.

    reports(report_id, comment_id, at, reason, status), comments(comment_id, note_id, user_id), notes(note_id, title).
    """
    pending = reports.where("status = 'pending'").groupBy("comment_id")
    grouped = pending.agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("at", "report_id", "reason"))).alias("reports"))
    return grouped.join(comments.select("comment_id", "note_id", "user_id"), "comment_id").join(notes.select("note_id", "title"), "note_id").orderBy("first_at", "comment_id")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those new rows, one per key, whose key it lacks."""
    fresh = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))).where("_rn = 1").drop("_rn")
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key; a new row's non-null values replace, its nulls keep what was there."""
    both = existing.alias("old").join(new.alias("new"), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in existing.columns if c not in keys])


def mark_read(notifications: DataFrame, recipient: str, at: Column, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows with the recipient's unread ones (or those of ``only``) read, and how many that were."""
    mine = (F.col("recipient_id") == recipient) & F.col("read_at").isNull()
    if only is not None:
        mine = mine & F.col("id").isin(only)
    return notifications.withColumn("read_at", F.when(mine, at).otherwise(F.col("read_at"))), notifications.agg(F.count_if(mine).alias("n"))


#: Fixed values of the moderation protocol: action -> (comment's status, report's status, report statuses it acts on).
MODERATION = {
    "hide": ("hidden", "resolved", ("pending",)),
    "dismiss": ("visible", "dismissed", ("pending",)),
    "restore": ("visible", "dismissed", ("pending", "resolved")),
}


def moderate(comments: DataFrame, reports: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments and reports after actions(comment_id, action), one action per comment; unknown actions change nothing."""
    acts = actions.where(F.col("action").isin(*MODERATION)).select("comment_id", "action")

    def chosen(i: int, old: str) -> Column:
        out = F.col(old)
        for name, to in MODERATION.items():
            out = F.when(F.col("action") == name, F.lit(to[i])).otherwise(out)
        return out

    touched = F.lit(False)
    for name, to in MODERATION.items():
        touched = touched | ((F.col("action") == name) & F.col("status").isin(*to[2]))
    new_comments = comments.join(acts, "comment_id", "left").withColumn("status", chosen(0, "status")).drop("action")
    new_reports = reports.join(acts, "comment_id", "left").withColumn("status", F.when(touched, chosen(1, "status")).otherwise(F.col("status"))).drop("action")
    return new_comments, new_reports


def notify(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """One notification per affected report and action: (recipient_id, event_key, kind)."""
    hit = reports.where("status = 'pending'").join(actions, "comment_id")
    return hit.select(F.col("reporter_id").alias("recipient_id"), F.concat_ws(":", F.lit("report"), "report_id", "action").alias("event_key"), F.col("action").alias("kind"))


def recent(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last ``k`` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rn") <= k).drop("_rn")


def redeem(attempts: DataFrame, invitations: DataFrame) -> DataFrame:
    """Attempts(code, user_id, email, at) that a valid invitation lets in, earliest first, while uses are left.

    invitations(code, expires_at, max_uses, use_count, disabled_at, email): not disabled, not expired at that time,
    e-mail unset or equal regardless of case.
    """
    ok = attempts.alias("a").join(invitations.alias("i"), "code").where(
        "i.disabled_at IS NULL AND (i.expires_at IS NULL OR i.expires_at > a.at) AND (i.email IS NULL OR lower(trim(i.email)) = lower(trim(a.email)))"
    )
    rank = F.row_number().over(Window.partitionBy("code").orderBy("a.at", "a.user_id"))
    return ok.withColumn("_rn", rank).where(F.col("_rn") <= F.coalesce(F.col("i.max_uses"), F.lit(2**31 - 1)) - F.col("i.use_count")).select("code", "a.user_id", "a.at")
