"""Reader queries: ``events`` stand for notifications, reports and commands, ``conversations`` for threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import hashing
from lectern.operators import flags, reader
from lectern.registry import Registry, table

_K = "get_json_object(props, '$.k')"


def register(r: Registry) -> None:
    @r.query(
        "reusable_explanation",
        """SELECT json_extract_string(props, '$.k') AS answer, min(event_type) AS quote, count(*) AS n FROM events
           WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, answer LIMIT 1""",
    )
    def reusable_explanation(spark, sf_dir):
        return reader.reusable_answer(table(spark, sf_dir, "events").select(F.expr(_K).alias("answer"), F.col("event_type").alias("q")), "q", "answer")

    @r.query(
        "popular_explanations",
        """SELECT event_type AS phrase, json_extract_string(props, '$.k') AS answer, min(CAST(user_id AS VARCHAR)) AS quote, count(*) AS n FROM events
           WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, quote, phrase, answer LIMIT 50""",
    )
    def popular_explanations(spark, sf_dir):
        e = table(spark, sf_dir, "events").select(F.col("event_type").alias("phrase"), F.expr(_K).alias("answer"), F.col("user_id").cast("string").alias("q"))
        return reader.popular_answers(e, "phrase", "answer", "q")

    @r.query(
        "notifications_keyset",
        """SELECT e.event_id, e.ts, e.user_id FROM events e, (SELECT ts AS t0, event_id AS i0 FROM events WHERE event_id = 500) c
           WHERE (e.ts, e.event_id) < (c.t0, c.i0) ORDER BY e.ts DESC, e.event_id DESC LIMIT 50""",
    )
    def notifications_keyset(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
        at = e.where("event_id = 500").select("ts", "event_id").first()
        return reader.keyset_page(e, ["ts", "event_id"], (at.ts, at.event_id), 50)

    @r.query(
        "unread_count",
        "SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS unread FROM events GROUP BY user_id",
    )
    def unread_count(spark, sf_dir):
        return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("unread"))

    @r.query(
        "thread_nested",
        """
        WITH n AS (SELECT DISTINCT conv_id AS note_id, CAST(conv_id % 1000 AS VARCHAR) AS user_id FROM conversations),
        p AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name FROM customer),
        c AS (SELECT conv_id AS note_id, conv_id * 1000 + turn AS comment_id, CAST((conv_id * 1000 + turn) % 2000 AS VARCHAR) AS user_id, turn, role FROM conversations),
        t AS (SELECT c.note_id, string_agg(c.turn || '/' || coalesce(p.name, 'Reader') || '/' || c.role || '/' || CASE WHEN c.comment_id % 5 = 0 THEN 'true' ELSE 'false' END, ';' ORDER BY c.turn, c.comment_id) AS comments
              FROM c LEFT JOIN p USING (user_id) GROUP BY c.note_id)
        SELECT n.note_id, coalesce(p.name, 'Reader') AS name, t.comments FROM n LEFT JOIN p USING (user_id) LEFT JOIN t USING (note_id)
        """,
    )
    def thread_nested(spark, sf_dir):
        conv = table(spark, sf_dir, "conversations")
        notes = conv.select(F.col("conv_id").alias("note_id"), (F.col("conv_id") % 1000).cast("string").alias("user_id")).distinct()
        profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"))
        cid = F.col("conv_id") * 1000 + F.col("turn")
        comments = conv.select(cid.alias("comment_id"), F.col("conv_id").alias("note_id"), (cid % 2000).cast("string").alias("user_id"), F.col("turn").alias("at"), F.col("role").alias("body"))
        out = reader.threads(notes, comments, profiles, comments.where("comment_id % 5 = 0"))
        line = F.transform("comments", lambda c: F.concat_ws("/", c["at"], c["name"], c["body"], c["reported"].cast("string")))
        return out.select("note_id", "name", F.array_join(line, ";").alias("comments"))

    @r.query(
        "report_queue",
        """
        WITH rep AS (SELECT event_id AS report_id, event_id % 300 AS comment_id, ts AS tm, event_type AS reason FROM events),
        com AS (SELECT DISTINCT event_id % 300 AS comment_id, event_id % 300 % 40 AS note_id FROM events)
        SELECT rep.comment_id, com.note_id, 'title ' || com.note_id AS title, min(tm) AS first_at, count(*) AS n,
               string_agg(report_id || ':' || reason, ',' ORDER BY tm, report_id) AS reports
        FROM rep JOIN com USING (comment_id) GROUP BY 1, 2, 3
        """,
    )
    def report_queue(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        reports = e.select(F.col("event_id").alias("report_id"), (F.col("event_id") % 300).alias("comment_id"), F.col("ts").alias("at"), F.col("event_type").alias("reason"), F.lit("pending").alias("status"))
        comments = e.select((F.col("event_id") % 300).alias("comment_id"), (F.col("event_id") % 300 % 40).alias("note_id"), F.lit("u").alias("user_id")).distinct()
        notes = comments.select("note_id", F.concat(F.lit("title "), F.col("note_id").cast("string")).alias("title")).distinct()
        out = reader.report_queue(reports, comments, notes)
        told = F.array_join(F.transform("reports", lambda x: F.concat_ws(":", x["report_id"], x["reason"])), ",")
        return out.select("comment_id", "note_id", "title", "first_at", "n", told.alias("reports"))

    @r.query(
        "insert_absent",
        """
        SELECT user_id, event_type, 0 AS origin FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0)
        UNION ALL
        SELECT user_id, event_type, 1 AS origin FROM (SELECT DISTINCT user_id, event_type FROM events n WHERE event_id % 2 = 1
          AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = n.user_id AND o.event_type = n.event_type))
        """,
    )
    def insert_absent(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        old = e.where("event_id % 2 = 0").select("user_id", "event_type").distinct().withColumn("origin", F.lit(0))
        return reader.insert_absent(old, e.where("event_id % 2 = 1").select("user_id", "event_type", F.lit(1).alias("origin")), ["user_id", "event_type"])

    @r.query(
        "upsert_coalesce",
        """
        WITH o AS (SELECT user_id, max(value) AS score, min(event_type) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
        n AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(value) END AS score, max(event_type) AS kind FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
        SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.score, o.score) AS score, coalesce(n.kind, o.kind) AS kind FROM o FULL JOIN n ON o.user_id = n.user_id
        """,
    )
    def upsert_coalesce(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("score"), F.min("event_type").alias("kind"))
        new = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.max("value").alias("score"), F.max("event_type").alias("kind"))
        return reader.upsert(old, new.withColumn("score", F.when(F.col("user_id") % 3 != 0, F.col("score"))), ["user_id"])

    @r.query(
        "moderation_transition",
        """
        WITH rep AS (SELECT event_id AS report_id, event_id % 300 AS comment_id, CASE event_id % 4 WHEN 0 THEN 'resolved' ELSE 'pending' END AS status FROM events),
        act AS (SELECT DISTINCT comment_id, CASE comment_id % 4 WHEN 0 THEN 'hide' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'restore' END AS action FROM rep WHERE comment_id % 4 <> 3)
        SELECT report_id, rep.comment_id,
               CASE WHEN action = 'hide' AND status = 'pending' THEN 'resolved' WHEN action = 'dismiss' AND status = 'pending' THEN 'dismissed'
                    WHEN action = 'restore' THEN 'dismissed' ELSE status END AS status
        FROM rep LEFT JOIN act USING (comment_id)
        """,
    )
    def moderation_transition(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        reports = e.select(F.col("event_id").alias("report_id"), (F.col("event_id") % 300).alias("comment_id"), F.when(F.col("event_id") % 4 == 0, "resolved").otherwise("pending").alias("status"))
        comments = reports.select("comment_id").distinct().withColumn("status", F.lit("visible"))
        action = F.element_at(F.array(F.lit("hide"), F.lit("dismiss"), F.lit("restore"), F.lit(None)), (F.col("comment_id") % 4 + 1).cast("int"))
        return reader.moderate(comments, reports, comments.select("comment_id", action.alias("action")))[1].select("report_id", "comment_id", "status")

    @r.query(
        "history_last20",
        "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20",
    )
    def history_last20(spark, sf_dir):
        return reader.recent(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", 20)

    @r.query(
        "redeem_invitations",
        """
        WITH a AS (SELECT 'c' || (event_id % 40) AS code, user_id, ts AS tm, event_id FROM events WHERE event_type = 'signup'),
        i AS (SELECT 'c' || k AS code, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 7 END AS max_uses, k % 2 AS used, k % 11 = 0 AS off FROM range(40) t(k)),
        ok AS (SELECT a.*, row_number() OVER (PARTITION BY a.code ORDER BY tm, user_id, event_id) AS rn, max_uses, used FROM a JOIN i USING (code) WHERE NOT off)
        SELECT code, count(*) AS redeemed FROM ok WHERE max_uses IS NULL OR rn <= max_uses - used GROUP BY code
        """,
    )
    def redeem_invitations(spark, sf_dir):
        attempts = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("code"), "user_id", F.lit(None).cast("string").alias("email"), F.col("ts").alias("at"))
        k = F.col("id")
        invitations = spark.range(40).select(
            F.concat(F.lit("c"), k.cast("string")).alias("code"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.when(k % 5 != 0, k % 7).alias("max_uses"), (k % 2).alias("use_count"),
            F.when(k % 11 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("disabled_at"), F.lit(None).cast("string").alias("email"),
        )
        return reader.redeem(attempts, invitations).groupBy("code").agg(F.count(F.lit(1)).alias("redeemed"))

    @r.query(
        "flag_bucket_users",
        "SELECT user_id, ('0x' || substr(sha256('salt:' || user_id), 1, 8))::BIGINT % 100 AS bucket FROM (SELECT DISTINCT user_id FROM events)",
    )
    def flag_bucket_users(spark, sf_dir):
        users = table(spark, sf_dir, "events").select("user_id").distinct()
        return users.select("user_id", hashing.bucket(F.concat(F.lit("salt:"), F.col("user_id").cast("string"))).alias("bucket"))

    @r.query(
        "flag_first_match",
        """
        WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events),
        b AS (SELECT user_id, ('0x' || substr(sha256('s:' || user_id), 1, 8))::BIGINT % 100 AS n FROM u)
        SELECT 'f' AS key, user_id, CASE WHEN user_id IN ('1', '5', '9') THEN false WHEN n < 30 THEN true ELSE false END AS enabled,
               CASE WHEN user_id IN ('1', '5', '9') THEN 'r1' WHEN n < 30 THEN 'r3' ELSE 'r4' END AS rule_id, CAST(7 AS BIGINT) AS revision FROM b
        """,
    )
    def flag_first_match(spark, sf_dir):
        users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id")).distinct()
        rule = "struct<id: string, conditionType: string, serve: boolean, percentage: int, bucketSalt: string, startsAt: timestamp, endsAt: timestamp, enabled: boolean, userIds: array<string>>"
        rules = [
            ("r1", "users", False, None, None, None, None, True, ["1", "5", "9"]),
            ("r2", "global", True, None, None, None, None, False, None),
            ("r3", "percentage", True, 30, "s", None, None, True, None),
            ("r4", "global", False, None, None, None, None, True, None),
        ]
        given = spark.createDataFrame([("f", 7, rules)], f"key string, revision bigint, rules array<{rule}>")
        return flags.evaluate(given, users, F.lit("2026-01-01").cast("timestamp"))

    @r.query(
        "flag_publish_fold",
        """
        WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 AS expected FROM events),
        f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS revision, CAST(NULL AS BIGINT) AS seq, false AS ok FROM (SELECT DISTINCT key FROM c)
              UNION ALL
              SELECT c.key, c.n, f.revision + CASE WHEN c.expected = f.revision THEN 1 ELSE 0 END, c.seq, c.expected = f.revision FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)
        SELECT key, seq, revision FROM f WHERE ok
        """,
    )
    def flag_publish_fold(spark, sf_dir):
        return flags.publish(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("expected")))
