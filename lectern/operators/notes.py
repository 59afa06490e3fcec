"""Footnotes in plain text: definitions at the beginning of a block, markers in the blocks before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a definition begins with: stars, or a number in brackets; paragraphs that are known as notes may also have round ones.
DEFINITION = r"(?s)^(\*+|\[[0-9]{1,3}\]|〔[0-9]{1,3}〕)\s*(.+)$"
NOTE_DEFINITION = r"(?s)^(\*+|\[[0-9]{1,3}\]|〔[0-9]{1,3}〕|\([0-9]{1,3}\)|（[0-9]{1,3}）)\s*(.+)$"
MARKER = r"\[[0-9]{1,3}\]|〔[0-9]{1,3}〕|\([0-9]{1,3}\)|（[0-9]{1,3}）"


def _number(mark: Column) -> Column:
    return F.regexp_extract(mark, "([0-9]+)", 1)


def footnotes(blocks: DataFrame, group: str, order: str, text: str, is_note: Column | None = None) -> DataFrame:
    """(group, order, label, body, kind, marker): each definition with the order of the block whose marker it explains, null if none is left.

    A number takes the last marker of that number before it that no other definition has taken, as brackets close; a star
    explains the block before. Definitions hold no markers; one of stars and dashes alone is none. Null texts are plain blocks.
    The matching is a running sum per number: a marker opens a level and a definition closes the one that is open.
    """
    told = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    note = F.coalesce(is_note if is_note is not None else F.lit(False), F.lit(False))
    found = lambda i: F.when(note, F.regexp_extract(told, NOTE_DEFINITION, i)).otherwise(F.regexp_extract(told, DEFINITION, i))
    cut = blocks.select(group, F.col(order).alias("_o"), told.alias("_t"), found(1).alias("_mark"), F.trim(found(2)).alias("_body"))
    is_def = (F.col("_mark") != "") & ~F.col("_body").rlike(r"^[*＊\s—-]*$")
    w = Window.partitionBy(group).orderBy("_o")
    cut = cut.withColumn("_d", is_def).withColumn("_before", F.lag("_o").over(w))
    stars = cut.where("_d AND startswith(_mark, '*')").select(group, F.col("_o").alias(order), F.col("_mark").alias("label"), F.col("_body").alias("body"), F.lit("editor-note").alias("kind"), F.col("_before").alias("marker"))
    null = F.lit(None).cast("string")
    closes = cut.where("_d AND NOT startswith(_mark, '*')").select(group, "_o", F.lit(0).alias("_i"), _number(F.col("_mark")).alias("label"), F.col("_body").alias("body"), F.lit(-1).alias("_x"))
    marks = cut.where("NOT _d").select(group, "_o", F.posexplode(F.regexp_extract_all("_t", F.lit(f"({MARKER})"), F.lit(1))).alias("_i", "_m"))
    opens = marks.select(group, "_o", "_i", _number(F.col("_m")).alias("label"), null.alias("body"), F.lit(1).alias("_x"))
    each = Window.partitionBy(group, "label").orderBy("_o", "_i")
    summed = opens.unionByName(closes).withColumn("_s", F.sum("_x").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.coalesce(F.min("_s").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a definition with nothing open only lowers the floor and stands on no level
    levelled = summed.withColumn("_f", floor).withColumn("_level", F.when(F.col("_x") == 1, F.col("_s") - F.col("_f")).when(F.col("_s") >= F.col("_f"), F.col("_s") - F.col("_f") + 1))
    open_one = F.lag("_o").over(Window.partitionBy(group, "label", "_level").orderBy("_o", "_i"))
    numbered = levelled.withColumn("_before", open_one).where("_x = -1").select(
        group, F.col("_o").alias(order), "label", "body", F.lit("footnote").alias("kind"), F.when(F.col("_level").isNotNull(), F.col("_before")).alias("marker")
    )
    return numbered.unionByName(stars)
