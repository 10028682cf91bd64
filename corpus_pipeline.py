"""A corpus in five stages: toxic documents go, bad ones go, one of each group of near copies stays, sources are mixed to
their target weights, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsemill.llm import jaccard_join, packing, source_mixing, toxicity, weak_quality
from sparsemill.llm.common import stage_table, table
from sparsemill.llm.encoding import tokenizer_path

#: Workers of the packing stage keep the ids of at most twice so many units, as the same workers serve the other stages too:
#: some 25 MB each, where op9's may keep 160 MB. Other units are merged anew, which costs CPU seconds and changes no id.
KEPT_UNITS = 60_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts have no clause and stay; rows without doc_id and repeated
    rows are judged like any others; an empty table stays empty; without labels listed insults alone decide."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer thinks bad go. Null and empty texts and those of a few bytes stay, as they say nothing;
    repeated rows are judged each; an empty table stays empty."""
    return weak_quality.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays, and one of several rows with one doc_id. Rows
    without words or without doc_id all stay; an empty table stays empty."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for. A null source is one of its own, null texts have no words,
    repeated rows share the draw; an empty table stays empty."""
    return source_mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of pieces, see packing.pack: null and empty texts are one token, repeated rows are packed each, a long text is as
    many pieces as it needs; an empty table gives no rows."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), kept=KEPT_UNITS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned filters, tokenizers and a genetic search are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents. Each stage's rows are a written table, from which the next starts.
    Other columns than doc_id, text and source pass through all stages but the last, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_table(docs, name)
    return docs
