"""Queries of this subpackage: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from lectern.llm import alignment, bpe, decontam, embdedup, filteraudit, langid, linededup, lm, ngramjoin, pii, suffixdedup, superkmer, transducer, twins
from lectern.llm.common import Scratch, crc_mod5, documents
from lectern.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(documents(spark, sf_dir), codec)


@REGISTRY.query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = crc_mod5("doc_id") == 0
    model = langid.fit(docs.where(~held_out))
    return langid.classify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "lang_pred", "score", "accepted")


@REGISTRY.query("op9_pii")
def op9_pii(spark, sf_dir):
    return pii.digests(documents(spark, sf_dir), Scratch(spark, "op9"))


@REGISTRY.query("op7_line_dedup", linededup.SQL)
def op7_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


@REGISTRY.query("op5_substring_dedup", twins.SUBSTRING_DEDUP)
def op5_substring_dedup(spark, sf_dir):
    return superkmer.digests(documents(spark, sf_dir), Scratch(spark, "op5"))


@REGISTRY.query("op10_lm_score")
def op10_lm_score(spark, sf_dir):
    return lm.score(documents(spark, sf_dir), Scratch(spark, "op10"))


@REGISTRY.query("op6_ngram_join", twins.NGRAM_JOIN)
def op6_ngram_join(spark, sf_dir):
    return ngramjoin.result(documents(spark, sf_dir), Scratch(spark, "op6"))


@REGISTRY.query("op3_embedding_dedup", twins.EMBEDDING_DEDUP)
def op3_embedding_dedup(spark, sf_dir):
    return embdedup.dedup(table(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


@REGISTRY.query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontam.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@REGISTRY.query("op2_suffix_dedup", twins.SUFFIX_DEDUP)
def op2_suffix_dedup(spark, sf_dir):
    return suffixdedup.digests(documents(spark, sf_dir), Scratch(spark, "op2"))


@REGISTRY.query("op13_streaming_bpe")
def op13_streaming_bpe(spark, sf_dir):
    import public_tokenizers

    return transducer.digests(documents(spark, sf_dir), transducer.StreamingBpe(spark, public_tokenizers.path("byte_bpe_50k.json")))


@REGISTRY.query("op12_alignment")
def op12_alignment(spark, sf_dir):
    import public_tokenizers

    cross = alignment.CrossTokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.digests(documents(spark, sf_dir), cross, Scratch(spark, "op12"))


@REGISTRY.query("op11_filter_audit", filteraudit.SQL)
def op11_filter_audit(spark, sf_dir):
    return filteraudit.report(documents(spark, sf_dir), table(spark, sf_dir, "labels"), Scratch(spark, "op11"))
