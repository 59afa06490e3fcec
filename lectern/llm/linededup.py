"""Line dedup: overlapping windows of three lines, in DataFrame operations alone.

A text is split at LF. Each three consecutive lines are a window, known by two 64-bit hashes. A
window that also occurs earlier (in a document of a smaller id, or before it in the same document) is a later
occurrence, and all lines that later occurrences cover are removed. The windows are those of the input, not of
what is left.

Texts of fewer than three lines have no window and stay as they are, so do null texts (0 lines) and
empty ones (1 line). Null ids come before all others. Rows with the same id are copies of one
document and lose the same lines. Other columns pass through unchanged, whatever their names; ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def window_hashes(lines: str, width: int = WIDTH) -> F.Column:
    """Structs (h1, h2) of each ``width`` consecutive elements; empty where there are fewer."""
    names = ", ".join(f"{lines}[i + {k}]" for k in range(width))
    hashed = f"named_struct('h1', xxhash64({names}), 'h2', xxhash64('second', {names}))"
    return F.expr(f"transform(sequence(0, greatest(size({lines}) - {width}, 0)), i -> {hashed})")


def later_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(_id, places): the windows of each document that occur earlier as well, as indices of their first lines."""
    lines = df.select(F.col(doc_id).alias("_id"), F.split(text, "\n", -1).alias("_lines")).where(F.size("_lines") >= width)
    at = lines.select("_id", F.posexplode(window_hashes("_lines", width)).alias("pos", "h")).select("_id", "pos", "h.h1", "h.h2")
    firsts = at.groupBy("h1", "h2").agg(F.min(F.struct("_id", "pos")).alias("first"), F.max(F.struct("_id", "pos")).alias("last")).where("first < last")
    later = at.join(firsts, ["h1", "h2"]).where("first < struct(_id, pos)")
    return later.groupBy("_id").agg(F.collect_set("pos").alias("places"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with the text cut, ``n_lines`` and ``n_removed``; columns of these two names in ``df`` are replaced, any others stay."""
    # a row's columns travel as one struct, so that none can clash with those made here
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("id"))
    places = later_windows(df, doc_id, text, width).withColumnRenamed("_id", "of")
    joined = rows.join(places, rows["id"].eqNullSafe(places["of"]), "left").withColumn("lines", F.split(F.col("row")[text], "\n", -1))
    # merged positions: line i goes if a later window starts at i, i-1 or i-2
    covered = joined.select("row", "lines", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (width - 1))))).alias("covered"))
    # lines and covered positions in one sorted array: a line goes if its own position stands before it
    line = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("line")))
    gone = F.transform("covered", lambda i: F.struct(i.cast("int").alias("i"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))
    merged = covered.select("row", "lines", F.size("covered").alias("gone"), F.when(F.col("covered").isNotNull(), F.array_sort(F.concat(line, gone))).alias("merged"))
    kept = F.expr("transform(filter(merged, (x, j) -> x.kind = 1 AND NOT (j > 0 AND merged[greatest(j - 1, 0)].i = x.i)), x -> x.line)")
    own = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    return merged.select(
        *[F.when(F.col("merged").isNull(), F.col("row")[c]).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col("row")[c].alias(c) for c in own],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("merged").isNull(), 0).otherwise(F.col("gone")).cast("bigint").alias("n_removed"),
    )


SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM docs),
win AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
kept AS (SELECT a.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(CASE WHEN g.pos IS NULL THEN a.line END, chr(10) ORDER BY a.pos), '') AS text
         FROM placed a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
