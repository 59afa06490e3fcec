"""Feature flags: buckets, ordered rules, validation, and the history of publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.hashing import bucket


def active(starts: Column, ends: Column, now: Column) -> Column:
    """Half-open [starts, ends); a missing bound is open."""
    return (starts.isNull() | (starts <= now)) & (ends.isNull() | (now < ends))


#: Flags that are sent to every task; more meet the users without a broadcast.
BROADCAST_FLAGS = 10_000


def evaluate(flags: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(key, user_id, enabled, rule_id, revision) for each flag and user: the first matching enabled rule decides.

    flags(key, revision, rules): each rule has id, conditionType, serve, percentage, bucketSalt, startsAt, endsAt, enabled,
    userIds. A null user_id is anonymous. Without a match: off, no rule, the flag's revision. A flag's rules stay one array, of which each row takes the first
    that matches, so that nothing is shuffled but to find the distinct users.
    """
    user, signed_in = F.col("user_id"), F.col("user_id").isNotNull()

    def hit(r: Column) -> Column:
        match = (
            F.when(r["conditionType"] == "global", F.lit(True))
            .when(r["conditionType"] == "authenticated", signed_in)
            .when(r["conditionType"] == "users", signed_in & F.array_contains(r["userIds"], user))
            .when(r["conditionType"] == "percentage", signed_in & (bucket(F.concat_ws(":", r["bucketSalt"], user)) < r["percentage"]))
            .otherwise(F.lit(False))
        )
        return F.coalesce(r["enabled"] & active(r["startsAt"], r["endsAt"], now) & match, F.lit(False))

    given = flags.select("key", "revision", "rules")
    if given.limit(BROADCAST_FLAGS + 1).count() <= BROADCAST_FLAGS:
        given = F.broadcast(given)
    first = F.get(F.filter("rules", hit), F.lit(0))
    each = users.select("user_id").distinct().crossJoin(given).select("key", "user_id", "revision", first.alias("first"))
    return each.select("key", "user_id", F.coalesce("first.serve", F.lit(False)).alias("enabled"), F.col("first.id").alias("rule_id"), "revision")


def rule_errors(flags: DataFrame) -> DataFrame:
    """(key, code) of each broken constraint: 1 to 50 rules, one enabled global fallback at the end, names, percentages."""
    checks = {
        "rule_count": "size(rules) NOT BETWEEN 1 AND 50",
        "fallback": "size(filter(rules, r -> r.isFallback)) <> 1 OR NOT element_at(rules, -1).isFallback OR NOT element_at(rules, -1).enabled OR element_at(rules, -1).conditionType <> 'global'",
        "name": "exists(rules, r -> r.name IS NULL OR length(trim(r.name)) NOT BETWEEN 1 AND 120)",
        "percentage": "exists(rules, r -> r.conditionType = 'percentage' AND (r.percentage IS NULL OR r.percentage NOT BETWEEN 1 AND 100))",
        "users": "exists(rules, r -> r.conditionType = 'users' AND coalesce(size(r.userIds), 0) = 0)",
        "window": "exists(rules, r -> coalesce(r.startsAt >= r.endsAt, false))",
        "duplicate_id": "size(array_distinct(transform(rules, r -> r.id))) <> size(rules)",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(True)), F.lit(k)) for k, c in checks.items()]))
    return flags.select("key", F.explode(found).alias("code"))


def publish(commands: DataFrame) -> DataFrame:
    """Which commands(key, seq, expected) take effect: each must expect the revision that the ones before it left.

    Revisions start at 0 and an accepted command adds 1. The fold runs within a key, over the array of its commands.
    """
    ordered = commands.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "expected"))).alias("cs"))
    start = F.expr("CAST(array() AS array<struct<seq: bigint, revision: bigint>>)")
    grown = F.aggregate(
        "cs", start,
        lambda acc, c: F.when(c.expected == F.size(acc), F.concat(acc, F.array(F.struct(c.seq.cast("bigint").alias("seq"), (F.size(acc) + 1).cast("bigint").alias("revision"))))).otherwise(acc),
    )
    return ordered.select("key", F.explode(grown).alias("x")).select("key", "x.seq", "x.revision")


def history(accepted: DataFrame, keep: int = 20) -> DataFrame:
    """The last ``keep`` accepted publications of each key."""
    return accepted.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("revision")))).where(F.col("_rn") <= keep).drop("_rn")
