"""The corpus pipeline: documents in, packed sequences out. Part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

Defined results: a null or blank text fails the quality rules and goes there; a row without id goes only if the quality
rules reject it, as the later stages decide by id; rows of one id are one document and stay or go together; of like documents
the smallest doc_id stays; an empty table gives no rows; texts of any length are read whole; further columns are kept up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm import decontam, lines, minhash, packing, quality
from rulewright.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the surface rules and the likelihood ratio."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of like lines keeps its first; documents left without a word go."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, a similarity of 0.8 or more."""
    return minhash.dedup(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place in it."""
    return packing.pack_documents(docs, with_ids=False, added=packing.tokenizer_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Stages that SQL cannot express (tokens, subset sums); tests run it on made documents whose fate is known, and every
#: stage on rows without content.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
