"""Corpus preparation: quality, near-duplicates, repeated passages, benchmark leaks, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import decontamination, pieces, quality_cnn, simhash, units
from spanledger.session import checkpoint, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network keeps; it learns from the labels of documents not held out."""
    network = quality_cnn.fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.score_quality(docs, network).filter("quality_kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are 0.8 alike or more in five-word shingles, the one of the least id.

    Rows of the same id count once; rows without an id cannot be named as a group's document and stay.
    """
    groups = settled(spark, lambda: simhash.similar_groups(docs, similarity=0.8, width=5))
    kept = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("rows"))
    # tables of their real sizes: only one of the joins has to move the documents, and none where the ids to leave out are few
    other = checkpoint(kept.filter("rows <> 1").select("doc_id"))
    several = checkpoint(kept.filter("rows > 1").select("doc_id"))
    repeated = docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.join(other, "doc_id", "left_anti").unionByName(repeated)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences and lines that an earlier one has; ``n_chars`` follows the text."""
    size = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    renewed = {"text": F.col("text"), "n_chars": size}
    return units.remove_repeats(docs).select(*[renewed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Contamination is a property of the text, so equal texts share it."""
    keyed = docs.select(F.xxhash64("text").alias("key"), "text").filter("text IS NOT NULL")
    found = decontamination.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    leaked = checkpoint(found.filter("contaminated").select(F.col("key").alias("_leaked")).distinct())
    return docs.join(leaked, F.xxhash64(docs["text"]) == leaked["_leaked"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document by seeded merge-dropout, decoded again as a check."""
    return pieces.encode_documents(docs, pieces.load_vocabulary())


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encode", encode),
]

#: A trained network decides the first stage, which SQL cannot express; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
