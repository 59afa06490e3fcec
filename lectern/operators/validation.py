"""A release's output checked in one pass: errors as rows, counts observed while they are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Kinds of rows that are counted, and how a report names their totals. Fixed values.
TOTALS = {"dataset": "datasets", "item": "items", "fragment": "chapters", "document": "searchDocuments"}


@dataclass
class Summary:
    """Numbers of rows by kind, of errors, and the first errors in their order; all errors are in the written table."""

    counts: dict[str, int]
    errors: int
    first: list[str]


def checked(datasets: DataFrame, items: DataFrame, fragments: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, object, errors): each row of a release with what is wrong with it, for all four tables in one plan.

    datasets(dataset, index_dataset, object), items(dataset, item_id, manifest_item, object, in_report), fragments(object, kind, item_id, manifest_item, chapter_id, fragment_id, size, sha256, content, toc_target),
    documents(manifest_object, fragment_object). An item's manifest is ``object``; a fragment's content is read once for its size and digest.
    Fragments of the kind *chapter* have an identity, those of the kind *search* a target that must be a chapter of their item, *asset* and *export* neither.
    """
    text = lambda c, what: F.when(c, F.lit(what))
    row = lambda kind, obj, *found: [F.lit(kind).alias("kind"), obj.alias("object"), F.array_compact(F.array(*found)).alias("errors")]
    d = datasets.select(*row("dataset", F.col("object"), text(~F.col("index_dataset").eqNullSafe(F.col("dataset")), "dataset id differs")))
    i = items.select(*row("item", F.col("object"), text(~F.col("manifest_item").eqNullSafe(F.col("item_id")), "item id differs"), text(~F.coalesce("in_report", F.lit(False)), "item is not in the report")))
    chapters = fragments.where("kind = 'chapter'").select(F.col("item_id").alias("_item"), F.col("chapter_id").alias("_target")).distinct()
    aimed = fragments.join(chapters, (F.col("kind") == "search") & (F.col("item_id") == F.col("_item")) & (F.col("toc_target") == F.col("_target")), "left")
    own = (F.col("kind") == "chapter") & (~F.col("fragment_id").eqNullSafe(F.col("chapter_id")) | ~F.col("item_id").eqNullSafe(F.col("manifest_item")))
    content = F.coalesce("content", F.lit(b""))
    f = aimed.select(
        *row("fragment", F.col("object"), text(~F.col("size").eqNullSafe(F.octet_length(content).cast("bigint")), "size differs"), text(~F.col("sha256").eqNullSafe(F.sha2(content, 256)), "digest differs"), text(own, "identity differs"), text((F.col("kind") == "search") & F.col("_target").isNull(), "target does not exist"))
    )
    # a document's two objects are looked up at once: known objects on one side, both names on the other
    known = items.select(F.col("object").alias("_o"), F.lit("manifest").alias("_k")).union(fragments.select("object", F.lit("fragment"))).distinct()
    asked = documents.withColumn("_n", F.monotonically_increasing_id()).select("_n", "manifest_object", F.explode(F.array(F.struct(F.lit("manifest").alias("_k"), F.col("manifest_object").alias("_o")), F.struct(F.lit("fragment").alias("_k"), F.col("fragment_object").alias("_o")))).alias("x")).select("_n", "manifest_object", "x.*")
    found = asked.join(known.withColumn("_there", F.lit(True)), ["_k", "_o"], "left")
    missing = found.groupBy("_n").agg(F.any_value("manifest_object").alias("manifest_object"), F.array_compact(F.array_sort(F.collect_list(F.when(F.col("_there").isNull(), F.concat("_k", F.lit(" does not exist")))))).alias("errors"))
    return d.union(i).union(f).union(missing.select(F.lit("document"), F.col("manifest_object"), "errors"))


def validate(rows: DataFrame, path: str, report: dict[str, int], show: int = 1_000) -> Summary:
    """Writes the errors of :func:`checked` below ``path`` and counts rows in the same job; compares totals with the ``report``.

    ``first`` holds at most ``show`` errors, of the written table in order, for people to read.
    """
    seen = Observation("release")
    counted = rows.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in TOTALS], F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))
    found = counted.select("kind", "object", F.explode("errors").alias("error"))
    found.write.mode("overwrite").parquet(path)
    told = seen.get
    counts = {k: told[k] for k in TOTALS}
    wrong = [f"{name} differ from the report" for k, name in TOTALS.items() if counts[k] != report.get(name)]
    written = rows.sparkSession.read.schema("kind string, object string, error string").parquet(path)
    first = [f"{r.object}: {r.error}" for r in written.orderBy("object", "error").limit(show).collect()] if told["errors"] else []
    return Summary(counts, told["errors"] + len(wrong), [*first, *wrong])
