"""Evaluation inputs as JSON lines, with row rules and digest bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = (
    "sample_id string, language string, authorization_id string, media_sha256 string, annotation_sha256 string, "
    "hotwords array<string>, core_context string, pair_id string, hint_variant string"
)
EVIDENCE_SCHEMA = (
    "evidence_type string, evidence_id string, start_ms bigint, end_ms bigint, text string, language string, "
    "confidence double, stream_index int, timestamp_ms bigint, sha256 string, size_bytes bigint"
)
EVIDENCE_TYPES = ["ASR_SEGMENT", "SUBTITLE_CUE", "KEYFRAME", "VISUAL_OBSERVATION"]


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with an explicit schema; blank lines vanish and broken lines keep their text."""
    return parse_json_lines(spark.read.text(path), "value", schema)


def parse_json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    body = lines.where(F.length(F.trim(F.col(column))) > 0)
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return body.select(*[c for c in lines.columns if c != column], parsed.alias("r")).select(
        *[c for c in lines.columns if c != column], "r.*")


def sample_status(samples: DataFrame) -> DataFrame:
    """Row status: CORRUPT, INVALID, DUPLICATE_ID or ACCEPTED."""
    copies = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("copies"))
    valid = F.col("sample_id").rlike("^[A-Za-z0-9_-]{3,128}$") & F.col("language").rlike("^([a-z]{2,3}|und)$")
    status = (
        F.when(F.col("_corrupt").isNotNull(), "CORRUPT").when(~F.coalesce(valid, F.lit(False)), "INVALID")
        .when(F.col("copies") > 1, "DUPLICATE_ID").otherwise("ACCEPTED")
    )
    return samples.join(copies, "sample_id", "left").withColumn("status", status).drop("copies")


def evidence_status(evidence: DataFrame) -> DataFrame:
    """Check the fields each evidence type requires."""
    timed = (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms"))
    needs = (
        F.when(F.col("evidence_type") == "ASR_SEGMENT", F.col("text").isNotNull() & F.col("confidence").between(0.0, 1.0))
        .when(F.col("evidence_type") == "SUBTITLE_CUE", F.length("text").between(1, 4000))
        .when(F.col("evidence_type") == "KEYFRAME", (F.col("timestamp_ms") >= F.col("start_ms")) & (F.col("timestamp_ms") < F.col("end_ms")))
        .otherwise(F.col("evidence_type") == "VISUAL_OBSERVATION")
    )
    known = F.col("evidence_type").isin(EVIDENCE_TYPES)
    status = F.when(F.col("_corrupt").isNotNull() | ~F.coalesce(known, F.lit(False)), "CORRUPT").when(
        ~F.coalesce(timed & needs, F.lit(False)), "INVALID").otherwise("ACCEPTED")
    return evidence.withColumn("status", status)


def bind_package(samples: DataFrame, annotations: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Join samples to their annotation and authorisation and name the first broken binding.

    ``authorizations`` has one row per (authorization_id, media_sha256) so that large
    licence lists stay rows rather than arrays.
    """
    notes = annotations.select("sample_id", F.col("media_sha256").alias("annotated_media"))
    licences = authorizations.select("authorization_id", "media_sha256").distinct().withColumn("licensed", F.lit(True))
    verdict = (
        F.when(F.col("annotated_media").isNull(), "ANNOTATION_MISSING")
        .when(F.col("annotated_media") != F.col("media_sha256"), "MEDIA_MISMATCH")
        .when(F.col("licensed").isNull(), "NOT_LICENSED").otherwise("BOUND")
    )
    return samples.join(notes, "sample_id", "left").join(licences, ["authorization_id", "media_sha256"], "left").select(
        "sample_id", verdict.alias("verdict"))
