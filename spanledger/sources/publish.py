"""Result tables: idempotent replace, ordered read and document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_runs(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the batch's runs replaced (for tables without partitions)."""
    kept = stored.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(batch)


def publish(batch: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite only the partitions the batch holds; repeating a publish changes nothing.

    ``partitions`` is the scope and a run bucket, so partition counts stay bounded. Rows are rebalanced by
    partition: Spark splits a large one over several writers by its size.
    """
    shaped = batch.hint("rebalance", *partitions)
    shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_result(chapters: DataFrame, summaries: DataFrame, supported: str) -> DataFrame:
    """Chapters of the runs with exactly one summary and one supported schema version."""
    counts = summaries.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    versions = chapters.groupBy("run_id").agg(F.min("schema_version").alias("lo"), F.max("schema_version").alias("hi"))
    good = counts.where("n = 1").join(versions.where((F.col("lo") == supported) & (F.col("hi") == supported)), "run_id")
    return chapters.join(good.select("run_id"), "run_id", "left_semi")


def write_documents(documents: DataFrame, path: str) -> None:
    """One row per document (run_id, content), in Parquet files of even size."""
    documents.select("run_id", "content").write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
