"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``docs``. Models and statistics are
fitted on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import decontam, langid, mixing, quality, simhash
from axiomata.llm.queries import crc_mod, vocab
from axiomata.llm.scratch import Scratch, scope

KEEP_QUALITY = 0.3
#: Documents whose language is less sure than this are rejected (as are those without a letter).
KEEP_LANGUAGE = 0.5
#: Texts whose sets of five-word shingles are this similar (Jaccard) are near copies, as are those within op4's radius.
NEAR = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below ``KEEP_QUALITY``; without labels every score is 0.5 and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    return quality.kept(docs, model, KEEP_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays unsure.

    Without any labelled language there is nothing to judge by: all stay.
    """
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2), vocab("piece_bpe_32k.model"))
    return langid.keep_identified(docs, model, KEEP_LANGUAGE) if model.langs else docs


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component."""
    return simhash.deduplicate(spark, docs, similar=NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within 20 % word edits."""
    return decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the mix leaves out; one row a document, with how often it counts for its source to meet the target: columns ``copies`` and ``taken``."""
    return mixing.mixed_rows(spark, docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]
#: Trained models, fingerprint components and edit matching are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the result is the last stage's table, and all other tables are deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), name, (docs,))
    return docs
