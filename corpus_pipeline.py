"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontam, langid, linededup, ngramjoin
from lectern.llm.common import Scratch, documents
from lectern.registry import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin."""
    model = langid.fit(docs)
    told = langid.classify(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("_text")), model, "_text")
    return told.where("accepted").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later occurrences of three-line windows cover."""
    cut = linededup.dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at a similarity of 0.8 on five-word shingles."""
    scratch = Scratch(spark, "pipeline-join")
    # a row's columns travel as one struct, so that none can clash with those made here
    held = scratch.save(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "held")
    groups = ngramjoin.join_components(held.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")), scratch, shingle=5, percent=80)
    named = held.select("uid", F.col("row.doc_id").alias("doc_id")).join(groups.select(F.col("doc_id").alias("uid"), "component_id"), "uid")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    stay = named.groupBy("component_id").agg(F.min_by("uid", order).alias("uid")).select("uid")
    return held.join(stay, "uid", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; rows of one id go together."""
    hits = decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the packed ids (little-endian unsigned 32-bit), their number, and digests of ids and decoded bytes."""
    import public_tokenizers

    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = codec.both(docs.select("doc_id", "lang", "source", "text"))
    return coded.select(
        "doc_id", "lang", "source", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokenise),
]

#: Stages that compress, hash words and tokenise can't be stated in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
