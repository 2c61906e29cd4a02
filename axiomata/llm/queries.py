"""The queries ``opN_<name>`` with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import ann, decontam, langid, licenses, lmscore, mixing, quality, simhash, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by range."""
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first_id END AS refers_to
FROM r
"""


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def vocab(name: str) -> str:
    """The place of a public vocabulary file; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(key: str, n: int):
    """crc32 of an id as text, modulo n; -1 for null, which is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, within 20 % word edits."""
    found = decontam.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "n_words", "at")


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows that are not held out."""
    docs = _docs(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 5) != 0))
    out = quality.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document."""
    return tokens.token_counts(_docs(spark, sf_dir), vocab("word_bpe_49k.json"), 2048).withColumnRenamed("id", "doc_id")


@_query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = _docs(spark, sf_dir)
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2), vocab("piece_bpe_32k.model"))
    out = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@_query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring each source to its target."""
    found = mixing.mix(spark, _docs(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


@_query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice of every document with its family."""
    return licenses.scan(_docs(spark, sf_dir), licenses.train()).withColumnRenamed("id", "doc_id")


@_query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every 20th vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(spark, vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@_query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-parsing scores of every document."""
    return lmscore.lm_scores(spark, _docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")
