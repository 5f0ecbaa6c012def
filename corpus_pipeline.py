"""The corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanaccord.llm import decontam, langid, linededup, packing, queries, simhash
from spanaccord.llm.common import table
from spanaccord.settings import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages; texts without letters and letter noise go.

    The model learns from the stage's own documents, as in the query of the operator.  What a language usually
    reads like is learnt beside it (``langid.Typical``), so the bound does not depend on the number of languages.
    """
    return langid.typical(docs, *langid.fit_typical(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, by equality or within two edits, leave the texts."""
    return linededup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles (similarity 0.8 or more) the one with the least doc_id stays.

    Of rows that repeat a doc_id the one with the least text hash stays; a null doc_id only stays in a group
    without any other.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit budget go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens dealt to sequences, with their token ids."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), ids=True)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
