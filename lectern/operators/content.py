"""Content building: best sources, merges, tables of contents, segments, chunks, integrity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import shared_folder


def best_by_key(rows: DataFrame, keys: list[str], quality: list[Column], position: str) -> tuple[DataFrame, DataFrame]:
    """(winners, losers): per key the row of the highest quality tuple, of equal ones the first by ``position``."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[q.desc_nulls_last() for q in quality], position)))
    return ranked.where("_rn = 1").drop("_rn"), ranked.where("_rn > 1").drop("_rn")


def merge_delivery(local: DataFrame, remote: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows of both sides by key, local values first; a row that both have gets the higher revision plus 1."""
    both = local.alias("l").join(remote.alias("r"), key, "full_outer")
    l, r = F.col(f"l.{revision}"), F.col(f"r.{revision}")  # noqa: E741
    rev = F.when(l.isNotNull() & r.isNotNull(), F.greatest(l, r) + 1).otherwise(F.coalesce(l, r))
    return both.select(key, rev.alias(revision), *[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in local.columns if c not in (key, revision)])


def without_replaced(remote: DataFrame, local: DataFrame, key: str, title: str, kinds: tuple[str, ...]) -> DataFrame:
    """Remote rows except those that a local row of the same title and kind, but another key, replaces."""
    new = local.where(F.col("type").isin(*kinds)).select(F.col(title).alias("_t"), F.col(key).alias("_k"))
    cond = (F.col(title) == F.col("_t")) & (F.col(key) != F.col("_k")) & F.col("type").isin(*kinds)
    return remote.join(new, cond, "left_anti")


def carry_forward(rows: DataFrame, group: str, order: str, *targets: str) -> DataFrame:
    """``target``: the first non-null of ``targets``, else that of the nearest row before."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("target", F.last(F.coalesce(*[F.col(t) for t in targets]), ignorenulls=True).over(w))


def parents(nodes: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """``parent``: the order of the nearest row before of a smaller level, if that is the level above; else null, as at the root.

    A level under 1 or null is 1. For each level that its group has, a row says that it opens the level below it, or that it closes those further down; a row's parent is what
    the last such word about its own level before it names. So a group is dealt out by its levels, and no group's rows are gathered.
    """
    nodes = nodes.withColumn(level, F.greatest(F.lit(1), F.coalesce(F.col(level).cast("int"), F.lit(1))))
    nodes = nodes.withColumn("_id", F.struct(F.col(order), F.col(level), F.monotonically_increasing_id()))
    below = nodes.select(group, F.col(level).alias("_k")).distinct()
    rows = nodes.select(group, "_id", F.col(order).cast("bigint").alias("_o"), F.col(level).alias("_l"))
    words = rows.join(below, group).where("_k > _l").select(group, "_k", "_id", F.struct(F.when(F.col("_k") == F.col("_l") + 1, F.col("_o")).alias("o")).alias("_w"))
    asked = nodes.withColumns({"_k": F.col(level), "_w": F.lit(None).cast("struct<o: bigint>")})
    before = Window.partitionBy(group, "_k").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    told = asked.withColumn("_asks", F.lit(True)).unionByName(words, allowMissingColumns=True).withColumn("parent", F.last("_w", ignorenulls=True).over(before)["o"])
    return told.where("_asks").drop("_id", "_k", "_w", "_asks")


def split_by_markers(markers: DataFrame, group: str, n: str) -> DataFrame:
    """(group, volume, first, next) where volumes 1..n are all marked in rising order; groups that aren't give no rows.

    markers(group, volume, idx, n): the first marker of a volume counts, the first range begins at 0.
    """
    firsts = markers.where(F.col("volume").between(1, F.col(n))).groupBy(group, "volume").agg(F.min("idx").alias("idx"), F.max(n).alias("_n"))
    w = Window.partitionBy(group).orderBy("volume")
    placed = firsts.withColumns({"_prev": F.lag("idx").over(w), "next": F.lead("idx").over(w)})
    ok = placed.groupBy(group).agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("m"), F.coalesce(F.bool_and(F.col("_prev") < F.col("idx")), F.lit(True)).alias("up")).where("c = m AND up")
    return placed.join(ok.select(group), group, "left_semi").select(group, "volume", F.when(F.col("volume") == 1, 0).otherwise(F.col("idx")).alias("first"), "next")


def segments(blocks: DataFrame, group: str, order: str, is_heading: Column) -> DataFrame:
    """``segment``: a run of headings opens a new one; rows before any heading are segment 0."""
    w = Window.partitionBy(group).orderBy(order)
    opens = is_heading & ~F.coalesce(F.lag(is_heading).over(w), F.lit(False))
    return blocks.withColumn("_o", opens.cast("int")).withColumn("segment", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_o")


def drop_adjacent_repeats(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """Rows with a non-blank value that differs from that of the row kept before."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_v", value).where("_v <> ''").withColumn("_b", F.lag("_v").over(w)).where("_b IS NULL OR _b <> _v").drop("_v", "_b")


def as_of(rows: DataFrame, marks: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the ``value`` of the last mark of its group at or before its order; null before the first."""
    both = marks.select(group, order, F.col(value), F.lit(0).alias("_k"), F.lit(None).cast(rows.schema[order].dataType).alias("_r")).unionByName(
        rows.withColumns({"_k": F.lit(1), value: F.lit(None).cast(marks.schema[value].dataType)}).select(group, order, value, "_k", F.col(order).alias("_r"), *[c for c in rows.columns if c not in (group, order)]), allowMissingColumns=True
    )
    w = Window.partitionBy(group).orderBy(order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_k = 1").drop("_k", "_r")


def completeness(toc: DataFrame, records: DataFrame, item: str, key: str) -> DataFrame:
    """Per item: expected, present, missing, unmatched and duplicate chapters and the share present (1 if none is expected)."""
    want = toc.select(item, key).distinct().withColumn("_w", F.lit(1))
    have = records.groupBy(item, key).agg(F.count(F.lit(1)).alias("_n"))
    both = want.join(have, [item, key], "full_outer")
    w, n = F.col("_w").isNotNull(), F.coalesce(F.col("_n"), F.lit(0))
    out = both.groupBy(item).agg(
        F.count_if(w).alias("expected"), F.count_if(w & (n > 0)).alias("present"), F.count_if(w & (n == 0)).alias("missing"),
        F.coalesce(F.sum(F.when(~w, n)), F.lit(0)).alias("unmatched"), F.coalesce(F.sum(F.when(w & (n > 1), n - 1)), F.lit(0)).alias("duplicate"),
    )
    return out.withColumn("coverage", F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("present") / F.col("expected")))


def integrity_errors(*checks: tuple[str, DataFrame, DataFrame, str, str]) -> DataFrame:
    """(code, object) of each row of a left side whose reference no right side has: checks of (code, left, right, column, target)."""
    found = [
        left.where(F.col(c).isNotNull()).join(right.select(F.col(t).alias("_t")).distinct(), F.col(c) == F.col("_t"), "left_anti").select(F.lit(code).alias("code"), F.col(c).cast("string").alias("object"))
        for code, left, right, c, t in checks
    ]
    return reduce(DataFrame.unionByName, found)


#: Marks after which a chunk may end, and the white space that is trimmed at its ends.
STOPS = "。！？\n"
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def chunk_spans(text: str, size: int, overlap: int, keep: float) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk of a text longer than ``size``."""
    a, n = 0, len(text)
    while True:
        b = min(n, a + size)
        if b < n:
            # a stop counts up to the place behind the chunk, and only beyond ``keep`` of the size
            low = a + int(size * keep) + 1
            stop = max(text.rfind(mark, low, b + 1) for mark in STOPS)
            b = stop + 1 if stop >= 0 else b
        yield a, b
        if b >= n:
            return
        a = b - overlap


def chunks(df: DataFrame, text: str, size: int = 1500, overlap: int = 150, keep: float = 0.55) -> DataFrame:
    """Each text in chunks of about ``size`` characters with ``overlap``: (…, chunk, pos, chunk_text), blank ones left out.

    A text of at most ``size`` is one chunk as it is. A longer one is cut behind the last stop mark at most at ``size`` (which counts) if
    that is beyond ``keep`` of the size, and its chunks are trimmed. Chunks are numbered from 0 once blank ones are out. Lengths are code points.
    Each text is gone over once, whatever its length.
    """
    if not 0 <= overlap < size * keep:
        raise ValueError("the overlap must be less than the least chunk")
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("chunk_text", pa.string())]))

    def of(value: str | None) -> list[dict]:
        if not value or len(value) <= size:
            return [{"pos": 0, "chunk_text": value}] if value else []
        cut = ((a, value[a:b].strip(SPACE)) for a, b in chunk_spans(value, size, overlap, keep))
        return [{"pos": a, "chunk_text": t} for a, t in cut if t]

    @F.arrow_udf("array<struct<pos: int, chunk_text: string>>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in texts.to_pylist()], kind)

    return df.select("*", F.posexplode(pieces(F.col(text))).alias("chunk", "_c")).select(*df.columns, "chunk", "_c.pos", "_c.chunk_text")


def flatten_tree(nodes: DataFrame, item: str) -> DataFrame:
    """nodes(item, node_id, parent_id, ord, …) with ``depth`` and ``path`` for pre-order.

    A node whose parent is not there is a root. Paths double: each round joins a node's path to that of the highest node it has come to,
    so a tree of d levels takes about log2(d) rounds. Nodes that lead to themselves are an error.
    """
    at = shared_folder(nodes.sparkSession, "tree")

    def saved(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{at}/{k}")
        return nodes.sparkSession.read.schema(df.schema).parquet(f"{at}/{k}")

    ids = nodes.select(item, F.col("node_id").alias("parent_id"), F.col("node_id").alias("up")).distinct()
    state = saved(nodes.select(item, "node_id", "parent_id", F.array("ord").alias("path")).join(ids, [item, "parent_id"], "left").select(item, "node_id", "up", "path"), 0)
    most, rounds = state.count(), 0
    while not state.where("up IS NOT NULL").isEmpty():
        if 2**rounds > most:
            raise ValueError("some nodes lead to themselves")
        above = state.select(F.col(item), F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        rounds += 1
        grown = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        state = saved(state.join(above, [item, "up"], "left").select(item, "node_id", F.col("_up").alias("up"), grown.alias("path")), rounds)
    return nodes.join(state.select(item, "node_id", (F.size("path") - 1).alias("depth"), "path"), [item, "node_id"]).select(*nodes.columns, "depth", "path")


def prune_tree(flat: DataFrame, targets: DataFrame, item: str) -> DataFrame:
    """Nodes of a flattened tree whose target is in targets(item, target_id) or that lead to one; others' targets are cleared."""
    kept = targets.select(item, "target_id").distinct().withColumn("_in", F.lit(True))
    marked = flat.join(kept, [item, "target_id"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    leads = marked.where("_in").select(item, F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path")).distinct()
    return marked.join(leads, [item, "path"], "left_semi").withColumn("target_id", F.when(F.col("_in"), F.col("target_id"))).drop("_in")


def outline(nodes: DataFrame, item: str) -> DataFrame:
    """The nodes of an outline that one can go to: (…, parent_id, depth, path) of nodes(item, node_id, parent_id, ord, title, dest).

    A node stays if it has a title and a destination of its own or below it; children of others move up to the nearest node that stays.
    """
    flat = flatten_tree(nodes.withColumn("title", F.trim("title")), item)
    named = F.coalesce(F.col("title"), F.lit("")) != ""
    prefixes = lambda least: F.transform(F.sequence(F.lit(1), F.size("path") - least), lambda k: F.slice("path", 1, k))
    leads = flat.where(named & F.col("dest").isNotNull()).select(item, F.explode(prefixes(0)).alias("path")).distinct()
    kept = flat.where(named).join(leads, [item, "path"], "left_semi")
    above = kept.where(F.size("path") > 1).select(item, F.col("path").alias("_of"), F.explode(prefixes(1)).alias("path"))
    near = above.join(kept.select(item, "path", F.col("node_id").alias("_up")), [item, "path"]).groupBy(item, "_of").agg(F.max_by("_up", F.size("path")).alias("_up"), F.count(F.lit(1)).alias("_depth"))
    out = kept.join(near.withColumnRenamed("_of", "path"), [item, "path"], "left")
    return out.withColumns({"parent_id": F.col("_up"), "depth": F.coalesce("_depth", F.lit(0)).cast("int")}).select(*flat.columns)


def totals_against(report: DataFrame, **tables: DataFrame) -> DataFrame:
    """(name, n, reported, ok) of each table against report(name, reported); a table that the report leaves out is not ok."""
    counted = reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])
    return counted.join(report.select("name", "reported"), "name", "left").withColumn("ok", F.coalesce(F.col("n") == F.col("reported"), F.lit(False)))


def size_budgets(chapters: DataFrame, item: str, size: str, budget: int = 32 << 20) -> DataFrame:
    """(item, chapters, bytes, median_bytes, fits): each item's chapters and whether all of them fit into a budget; null sizes count as 0."""
    value = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    out = chapters.groupBy(item).agg(F.count(F.lit(1)).alias("chapters"), F.sum(value).alias("bytes"), F.median(value).alias("median_bytes"))
    return out.withColumn("fits", F.col("bytes") <= budget)


def in_title_order(rows: DataFrame, title: str, *more: str, locale: str = "zh_Hans_CHN") -> DataFrame:
    """Rows by title as a locale sorts it, then by ``more``."""
    return rows.orderBy(F.collate(F.col(title), locale), *more)
