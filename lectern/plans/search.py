"""Search queries over ``documents``, with ``labels.toxic`` as the list of superseded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import search as ops
from lectern.registry import Registry, table


def register(r: Registry) -> None:
    @r.query(
        "search_quoted_topk",
        """
        WITH live AS (
          SELECT * FROM documents d WHERE contains(text, 'en')
          AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)),
        scored AS (SELECT doc_id, source, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS INT) AS score FROM live),
        best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM scored)
        SELECT doc_id, source, score FROM best WHERE rn = 1 ORDER BY score DESC, doc_id LIMIT 10
        """,
    )
    def search_quoted_topk(spark, sf_dir):
        superseded = table(spark, sf_dir, "labels").where("toxic = 1")
        hits = ops.exclude(table(spark, sf_dir, "documents").where(F.contains("text", F.lit("en"))), superseded, "doc_id")
        scored = hits.select("doc_id", "source", ops.occurrences(F.col("text"), "en").alias("score"))
        order = [F.desc("score"), F.asc("doc_id")]
        return ops.best_per_group(scored, "source", order).orderBy(*order).limit(10)

    @r.query(
        "exclude_superseded",
        "SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)",
    )
    def exclude_superseded(spark, sf_dir):
        return ops.exclude(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")

    @r.query(
        "keyword_boolean",
        """SELECT doc_id, lang FROM documents WHERE (contains(lower(text), 'token') OR contains(lower(text), 'licensed under'))
           AND NOT contains(lower(text), 'the the')""",
    )
    def keyword_boolean(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        return docs.where(ops.keyword_condition('(token or "licensed under") and not "the the"', F.col("text"))).select("doc_id", "lang")

    @r.query(
        "quoted_wildcard",
        "SELECT doc_id FROM documents WHERE regexp_matches(text, 'token = (?s:.)[0-9a-f]')",
    )
    def quoted_wildcard(spark, sf_dir):
        return table(spark, sf_dir, "documents").where(F.col("text").rlike(ops.wildcard("token = ?") + "[0-9a-f]")).select("doc_id")

    @r.query(
        "multi_match_topk",
        """
        WITH scored AS (
          SELECT doc_id, greatest(CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 4.0 ELSE 0.0 END,
                                  CASE WHEN contains(lower(source), 'the') AND contains(lower(source), 'and') THEN 3.0 ELSE 0.0 END) AS best,
                 CASE WHEN contains(lower(text), 'of the') OR contains(lower(source), 'of the') THEN 8.0 ELSE 0.0 END AS extra
          FROM documents)
        SELECT doc_id, CAST(best + extra AS DOUBLE) AS score FROM scored WHERE best > 0 ORDER BY score DESC, doc_id LIMIT 50
        """,
    )
    def multi_match_topk(spark, sf_dir):
        score = ops.multi_match(["the", "and"], [(F.col("text"), 4.0), (F.col("source"), 3.0)], "of the")
        hits = table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score IS NOT NULL")
        return hits.orderBy(F.desc("score"), "doc_id").limit(50)

    @r.query(
        "active_search",
        """SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'the') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100""",
    )
    def active_search(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").where(ops._all_in(F.col("text"), ["the"]))
        return docs.select("doc_id", "source", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(100)

    @r.query(
        "date_range_inclusive",
        "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'",
    )
    def date_range_inclusive(spark, sf_dir):
        orders = table(spark, sf_dir, "orders")
        return orders.where(ops.in_dates(F.col("o_orderdate"), "1996-01-01", "1996-03-31")).select("o_orderkey", "o_orderdate")

    def searched(spark, sf_dir, source, strict):
        o = table(spark, sf_dir, "orders")
        within = (F.col("o_orderstatus"), "F") if source else None
        cond = ops.search_condition('"URGENT"', F.col("o_orderpriority"), F.col("o_orderstatus"), within, (F.col("o_orderdate"), "1996-01-01", "1996-03-31"), strict)
        return o.where(cond).select("o_orderkey", "o_orderpriority")

    @r.query("quoted_in_dates", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URGENT') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
    def quoted_in_dates(spark, sf_dir):
        return searched(spark, sf_dir, False, False)

    @r.query("quoted_without_dates", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URGENT')")
    def quoted_without_dates(spark, sf_dir):
        return searched(spark, sf_dir, False, True)

    @r.query("quoted_in_source", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URGENT') AND o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
    def quoted_in_source(spark, sf_dir):
        return searched(spark, sf_dir, True, True)

    @r.query(
        "hashed_key_filter",
        "SELECT doc_id, source FROM documents WHERE sha256(source) IN (sha256('src1'), sha256('src7'))",
    )
    def hashed_key_filter(spark, sf_dir):
        wanted = spark.createDataFrame([("src1",), ("src7",)], "source string").select(F.sha2("source", 256).alias("_key"))
        docs = table(spark, sf_dir, "documents")
        return docs.join(wanted, F.sha2("source", 256) == F.col("_key"), "left_semi").select("doc_id", "source")

    @r.query(
        "overlay_merge",
        """
        WITH b AS (SELECT 'k' || (user_id % 500) AS logical_id, event_id % 3 AS version, value AS score, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS side FROM events),
        state AS (SELECT DISTINCT 'k' || (user_id % 500) AS logical_id, (user_id % 500) % 3 AS version, (user_id % 500) % 7 = 0 AS deleted FROM events),
        live AS (SELECT b.* FROM b LEFT JOIN state s USING (logical_id) WHERE s.logical_id IS NULL OR (NOT s.deleted AND b.version >= s.version)),
        best AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY version DESC, score DESC, side, seq) AS rn FROM live)
        SELECT logical_id, version, score, seq FROM best WHERE rn = 1
        """,
    )
    def overlay_merge(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        key = F.concat(F.lit("k"), (F.col("user_id") % 500).cast("string"))
        hits = e.select(key.alias("logical_id"), (F.col("event_id") % 3).alias("version"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
        changes = e.select(key.alias("logical_id"), ((F.col("user_id") % 500) % 3).alias("version"), ((F.col("user_id") % 500) % 7 == 0).alias("deleted"), F.col("event_id").alias("seq"))
        merged = ops.overlay_merge(hits.where("seq % 2 = 0"), hits.where("seq % 2 <> 0"), ops.latest_state(changes))
        return merged.select("logical_id", "version", "score", "seq")

    @r.query(
        "latest_patch_state",
        """
        SELECT user_id, version, event_type, seq FROM (
          SELECT user_id, event_id % 5 AS version, event_type, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5 DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1
        """,
    )
    def latest_patch_state(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("version"), "event_type", F.col("event_id").alias("seq"))
        return ops.latest_state(e, "user_id")

    @r.query(
        "offset_page",
        "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40",
    )
    def offset_page(spark, sf_dir):
        return ops.page(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 3, 20)

    @r.query(
        "distinct_targets",
        """
        WITH s AS (SELECT doc_id, source, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS score FROM documents WHERE contains(text, 'the')),
        b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM s)
        SELECT doc_id, source, score FROM b WHERE rn = 1 ORDER BY score DESC, doc_id LIMIT 8
        """,
    )
    def distinct_targets(spark, sf_dir):
        hits = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", "source", ops.occurrences(F.col("text"), "the").alias("score"))
        return ops.distinct_targets(hits, "source", [F.desc("score"), F.asc("doc_id")], 0)

    @r.query(
        "evidence_topk",
        """
        WITH s AS (SELECT doc_id, CAST((length(text) - length(replace(text, 'token', ''))) / 5 AS INT) AS n FROM documents)
        SELECT doc_id, n FROM s WHERE n > 0 OR NOT EXISTS (SELECT 1 FROM s WHERE n > 0) ORDER BY n DESC, doc_id LIMIT 6
        """,
    )
    def evidence_topk(spark, sf_dir):
        scored = table(spark, sf_dir, "documents").select("doc_id", ops.occurrences(F.col("text"), "token").alias("n"))
        return ops.with_fallback(scored.where("n > 0"), scored, [F.desc("n"), F.asc("doc_id")], 6)

    @r.query(
        "term_occurrences",
        """
        WITH t AS (SELECT unnest(['the', 'que', 'und', 'token']) AS term),
        c AS (SELECT term, doc_id, CAST((length(text) - length(replace(text, term, ''))) / length(term) AS BIGINT) AS n FROM documents, t)
        SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS documents FROM c GROUP BY term
        """,
    )
    def term_occurrences(spark, sf_dir):
        terms = ["the", "que", "und", "token"]
        docs = table(spark, sf_dir, "documents")
        counted = docs.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), ops.occurrences(F.col("text"), t).alias("n")) for t in terms])).alias("x")).select("x.*")
        return counted.groupBy("term").agg(F.sum("n").cast("bigint").alias("total"), F.count_if(F.col("n") > 0).alias("documents"))
