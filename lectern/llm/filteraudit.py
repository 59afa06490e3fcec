"""Which filter removes what, in every order of a set of filters.

A row's *mask* has a bit for each filter that it fails. Of k filters there are 2^k masks and k! orders; :func:`first_failures` is the table of the step
at which a row of each mask falls in each order (k: never), 32 by 120 for five filters. A task looks rows' masks up in it and
adds up, by part, order, step and label, what is removed; the tasks' partial arrays are then summed by Spark.

Counts are of rows: repeated rows count each, and rows of one id share its labels (a label of several rows of ``labels``
holds if any row has it). A row without id has no labels and is never a copy, nor does it make another row one. A null part
is the empty string, a null text the empty text. An empty table has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, bounded_batches

#: Parts that a task holds arrays for (some kilobytes each); beyond it they are sent on and begun anew.
PARTS = 512
#: Filters that an audit can have: 8 make 256 masks by 40,320 orders.
MOST = 8
#: The five filters of the query and their letters: fixed values.
FEW_WORDS, FILTERS = 200, "ABCDE"


def first_failures(n: int) -> np.ndarray:
    """By mask and order (as ``permutations`` gives them): the step of the first filter in the mask, ``n`` if there is none."""
    if not 0 < n <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    orders = np.array(list(permutations(range(n))))
    fails = (np.arange(1 << n)[:, None, None] >> orders[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), n).astype(np.int8)


def _tally(n: int, labels: int):
    """The task's step: rows (part, mask, label bits) in, (part, mask counts, removals by label) out.

    ``masks``: rows by mask. ``removed``: rows by label (0: all), order and step, the last step being that of rows kept.
    """
    table = first_failures(n)
    orders, kinds = table.shape[1], 1 << labels
    cells = table.astype(np.int64) + np.arange(orders) * (n + 1)
    has = np.array([[True] * kinds, *([bool(kind >> k & 1) for kind in range(kinds)] for k in range(labels))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), *(pa.array([v[k].ravel() for v in held.values()], pa.list_(pa.int64())) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "masks", "removed"])

        for batch in batches:
            part = batch.column(0).dictionary_encode()
            mask, kind = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            of = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = part.dictionary.to_pylist()
            # rows that agree in part, mask and label are looked up once, with their number as weight
            alike = np.bincount((of * kinds + kind) << n | mask, minlength=len(names) * kinds << n).reshape(len(names), kinds, 1 << n)
            for i, name in enumerate(names):
                rows = alike[i]
                if name not in held:
                    if len(held) == PARTS:
                        yield sent()
                        held.clear()
                    held[name] = [np.zeros(1 << n, np.int64), np.zeros((labels + 1, orders * (n + 1)), np.int64)]
                masks, removed = held[name]
                masks += rows.sum(0)
                seen = np.flatnonzero(rows.sum(0))
                for label in range(labels + 1):
                    weight = rows[has[label]].sum(0)[seen]
                    removed[label] += np.bincount(cells[seen].ravel(), np.repeat(weight, orders).astype(np.float64), orders * (n + 1)).astype(np.int64)
        if held:
            yield sent()

    return run


def audit(df: DataFrame, filters: str, part: str, mask: str, labels: list[str], scratch: Scratch) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters``: a letter for each bit of the integer column ``mask``, the lowest first. ``labels``: boolean columns; the result
    has ``<label>_lost`` for each. Counts: ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), ``shapley`` (its filter's removals in all orders).
    """
    bounded_batches(df.sparkSession)
    n = len(filters)
    orders = list(permutations(range(n)))
    kind = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) * (1 << k) for k, c in enumerate(labels)), F.lit(0))
    rows = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(mask).cast("int").alias("mask"), kind.cast("int").alias("kind"))
    partial = rows.mapInArrow(_tally(n, len(labels)), "part string, masks array<bigint>, removed array<bigint>")

    # both arrays in one, so that one shuffle sums them: a part's cells are keys of their own
    cell = partial.select("part", F.posexplode(F.concat("masks", "removed")).alias("cell", "n"))
    total = scratch.save(cell.groupBy("part", "cell").agg(F.sum("n").alias("n")), "cells")  # read twice below

    size = 1 << n
    # the few hundred cells, by what they stand for: order (a row of permutations), step, filter at that step
    steps = [("".join(filters[f] for f in order), step + 1, order[step], size + k * (n + 1) + step) for k, order in enumerate(orders) for step in range(n)]
    stride = len(orders) * (n + 1)
    spark = df.sparkSession
    plan = spark.createDataFrame([(o, s, f, c) for o, s, f, c in steps], "filter_order string, step int, filter int, cell int")

    masks = total.where(F.col("cell") < size)
    fails = [F.sum(F.when(F.col("cell").bitwiseAND(1 << f) != 0, F.col("n")).otherwise(0)).alias(f"fails_{f}") for f in range(n)]
    only = [F.sum(F.when(F.col("cell") == (1 << f), F.col("n")).otherwise(0)).alias(f"only_{f}") for f in range(n)]
    by_part = masks.groupBy("part").agg(F.sum("n").alias("rows"), *fails, *only)

    place = total.where(F.col("cell") >= size).select("part", "n", (F.col("cell") - size).alias("at"))
    place = place.select("part", "n", (F.col("at") % stride + size).cast("int").alias("cell"), F.expr(f"at div {stride}").alias("label"))
    counts = place.groupBy("part", "cell").agg(*(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(["removed", *(f"{c}_lost" for c in labels)])))
    found = counts.join(F.broadcast(plan), "cell").join(by_part, "part")

    def pick(name: str) -> F.Column:
        return reduce(lambda rest, f: F.when(F.col("filter") == f, F.col(f"{name}_{f}")).otherwise(rest), range(n), F.lit(0)).cast("bigint")

    in_order = Window.partitionBy("part", "filter_order").orderBy("step")
    return found.select(
        "part", "filter_order", "step",
        (F.col("rows") - F.sum("removed").over(in_order)).alias("kept"),
        "removed",
        (pick("fails") - F.col("removed")).alias("redundant"),
        pick("only").alias("unique_fails"),
        *(f"{c}_lost" for c in labels),
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


# --- the query's filters ---------------------------------------------------------------------------


def text_facts(text: F.Column) -> tuple[F.Column, F.Column]:
    """The four filters that a text fails by itself (bits of A to D), and a digest that stands for the text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    bits = [
        F.size(words) < FEW_WORDS,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * F.size(words).cast("bigint"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > 2 * F.length(text).cast("bigint"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0)), F.unhex(F.sha2(text, 256))


def failing(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic) per row of ``docs``, with the fifth filter: a smaller id has the same text.

    Texts are read once. Rows meet the least id of their text by text *and* id, so that a text of very many copies is spread.
    """
    own, same = text_facts(F.col("text"))
    facts = scratch.save(docs.select("doc_id", F.col("source").alias("part"), own.alias("own"), same.alias("same")), "facts")
    known, rest = facts.where("doc_id IS NOT NULL"), facts.where("doc_id IS NULL")
    first = scratch.save(known.groupBy("same").agg(F.min("doc_id").alias("doc_id")), "first").withColumn("is_first", F.lit(True))
    kinds = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    kinds = scratch.save(kinds, "kinds")
    told = known.join(first, ["doc_id", "same"], "left").join(kinds, "doc_id", "left")
    mask = F.col("own") + F.when(F.col("is_first"), 0).otherwise(16)
    alone = rest.select("part", F.col("own").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return told.select("part", mask.alias("mask"), "good", "toxic").unionByName(alone)


def report(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The audit of the five filters by source. Extra columns of either table are not looked at."""
    rows = failing(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), scratch)
    return audit(rows, FILTERS, "part", "mask", ["good", "toxic"], scratch)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
f AS (SELECT w.doc_id, part, text,
 len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS C,
 regexp_matches(text, '[#$%&*|]') AS D, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS E FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, [A, B, C, D, E] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM r GROUP BY part, fails),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, s.i, u.i, v.i] AS o FROM i p, i q, i s, i u, i v WHERE len(list_distinct([p.i, q.i, s.i, u.i, v.i])) = 5),
x AS (SELECT part, o, step, fails[o[step]] AS bad, NOT list_contains([fails[k] FOR k IN o[1:step - 1]], true) AS here, list_sum([CAST(z AS INT) FOR z IN fails]) AS fallen, n, good, toxic
      FROM g, o, (SELECT i AS step FROM i)),
c AS (SELECT part, o, step, coalesce(sum(n) FILTER (here AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (here AND bad), 0) AS removed, coalesce(sum(n) FILTER (NOT here AND bad), 0) AS redundant,
      coalesce(sum(n) FILTER (bad AND fallen = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND bad), 0) AS toxic_lost FROM x GROUP BY part, o, step)
SELECT part, array_to_string([substr('ABCDE', k, 1) FOR k IN o], '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM c
"""
