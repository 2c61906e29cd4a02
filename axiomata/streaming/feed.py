"""Append-only feeds of documents: parsing as a stream and keeping derived tables current.

New documents only add axioms, and asserted views and EL saturation are
monotone, so a micro-batch is parsed, its axioms are appended, and views
are refreshed from the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from axiomata.model import Ontology
from axiomata.sources import ofn


def axioms(spark: SparkSession, path: str) -> DataFrame:
    """A stream of axiom rows from documents that arrive at ``path``; malformed ones give rows with an error."""
    texts = spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("onto"), "value")
    return ofn.parse_column(texts, "onto", "value", permissive=True)


def append(spark: SparkSession, path: str, table: str, checkpoint: str, refresh: Callable[[Ontology, int], None] | None = None, **trigger) -> StreamingQuery:
    """Append the axioms of arriving documents to Parquet at ``table``; ``refresh`` sees the whole ontology after each batch.

    A batch is a folder of its own, overwritten when it runs again after a
    failure, so no axiom is written twice. ``trigger`` is passed to the stream (availableNow by default).
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.filter("error is null").drop("error").withColumn("idx", F.col("idx") + (F.xxhash64("onto").bitwiseAND(F.lit((1 << 30) - 1)) * (1 << 32)))
        rows.write.mode("overwrite").parquet(f"{table}/batch={n}")
        if refresh:
            refresh(Ontology(df.sparkSession.read.parquet(table).drop("batch", "onto")), n)

    return axioms(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
