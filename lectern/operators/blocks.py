"""Page blocks from OCR: cleaning, headings, chapters, numbering, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_page_mark, trim_spaces

#: Headings that name a chapter, part or volume.
CHAPTER = r"^\s*(第[零〇一二三四五六七八九十百0-9]+[章节回卷部篇编]|(?i:chapter|part|volume|book)\s+[0-9ivxlc]+)"


def clean(blocks: DataFrame, watermark: str | None = r"(?i)^\s*(scanned by|watermark)", bare: bool = False) -> DataFrame:
    """Blocks with white space collapsed, without page numbers, blank texts, page marks and watermarks (None: there are none).

    ``bare``: only numbers without dots or dashes around them are page marks, for texts whose lines may be short sentences.
    """
    text = trim_spaces(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    kept = blocks.withColumn("text", text).where(F.coalesce(F.col("type"), F.lit("")) != "page_number").where("text <> ''")
    marked = kept.where(~is_page_mark(F.col("text"), bare))
    return marked if watermark is None else marked.where(~F.col("text").rlike(watermark))


def unnamed_headings(blocks: DataFrame) -> DataFrame:
    """Headings that don't name a chapter, for review."""
    return blocks.where((F.col("type") == "heading") & ~F.col("text").rlike(CHAPTER))


def chapters(blocks: DataFrame, group: str, order: str, longest: int = 96) -> DataFrame:
    """(group, chapter, title, blocks): a run of headings opens a chapter and its first three make the title.

    A title is cut to ``longest`` characters with …; a chapter without heading has the beginning of its first text.
    """
    heading = F.col("type") == "heading"
    w = Window.partitionBy(group).orderBy(order)
    opens = (heading & ~F.coalesce(F.lag(heading).over(w), F.lit(False))).cast("int")
    placed = blocks.withColumn("_o", opens).withColumn("chapter", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    held = placed.groupBy(group, "chapter").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "type", "text"))).alias("bs"))
    heads = F.slice(F.filter(F.transform(F.filter("bs", lambda b: b["type"] == "heading"), lambda b: b["text"]), lambda t: t != ""), 1, 3)
    joined = F.array_join(heads, " - ")
    title = F.when(F.length(joined) > longest, F.concat(F.substring(joined, 1, longest - 1), F.lit("…"))).otherwise(joined)
    first = F.substring(F.try_element_at("bs", F.lit(1))["text"], 1, 80)
    return held.select(group, "chapter", F.when(F.size(heads) > 0, title).otherwise(first).alias("title"), F.size("bs").cast("bigint").alias("blocks"))


def note_labels(notes: DataFrame, group: str, order: str, is_title: Column) -> DataFrame:
    """``label``: notes of titles are *, **, …; other notes are numbered from 1 after each title."""
    w = Window.partitionBy(group).orderBy(order)
    part = notes.withColumn("_t", is_title).withColumn("_s", F.sum(F.col("_t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stars = F.row_number().over(Window.partitionBy(group, "_t").orderBy(order))
    number = F.row_number().over(Window.partitionBy(group, "_s", "_t").orderBy(order))
    return part.withColumn("label", F.when(F.col("_t"), F.repeat(F.lit("*"), stars)).otherwise(number.cast("string"))).drop("_t", "_s")


def page_of(blocks: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """``page``: a block's page in its part plus the pages of the parts before; parts(group, part, pages)."""
    w = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("pages").over(w), F.lit(0))).select(group, "part", "_before")
    return blocks.join(before, [group, "part"]).withColumn("page", F.col("page_in_part") + F.col("_before")).drop("_before")


def markdown(blocks: DataFrame, group: str, order: str) -> DataFrame:
    """(group, markdown): headings with # by level, other blocks as paragraphs."""
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), "text")).otherwise(F.col("text"))
    listed = blocks.select(group, F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select(group, F.array_join(F.transform("xs", lambda x: x["l"]), "\n\n").alias("markdown"))


def progress(reads: DataFrame, chapters: DataFrame, item: str) -> DataFrame:
    """(item, percent) from reads(item, idx, percent in chapter) and the number of chapters; 0 without chapters, 100 at most."""
    n = chapters.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    share = F.round((F.col("idx") + F.col("percent") / 100) / F.col("_n") * 100).cast("int")
    return reads.join(n, item, "left").select(item, F.when(F.coalesce("_n", F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), share)).alias("percent"))
