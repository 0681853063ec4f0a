"""Pluggable model calls as batch functions over DataFrames.

A port is ``fn(batch: pandas.DataFrame) -> pandas.DataFrame``. The caller supplies it;
the defaults below are deterministic and need no model. ``concurrency`` bounds the
number of calls that run at once, as partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Port = Callable[[pd.DataFrame], pd.DataFrame]


def call_port(requests: DataFrame, port: Port, schema: str, concurrency: int | None = None) -> DataFrame:
    """Run the port over Arrow batches of the requests."""
    spread = requests if concurrency is None else requests.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield port(batch)

    return spread.mapInPandas(run, schema)


def transcribe(windows: DataFrame, port: Port | None = None, concurrency: int | None = None) -> DataFrame:
    """Recogniser port: one language and one list of relative segments per window.

    Input columns: run_id, chunk_index, start_ms, end_ms.
    """
    schema = "run_id bigint, chunk_index bigint, language string, rel_start_ms bigint, rel_end_ms bigint, text string, confidence double"
    return call_port(windows.select("run_id", "chunk_index", "start_ms", "end_ms"), port or silent_recognizer, schema, concurrency)


def silent_recognizer(batch: pd.DataFrame) -> pd.DataFrame:
    """Default recogniser: one placeholder segment that fills its window."""
    return pd.DataFrame({
        "run_id": batch.run_id, "chunk_index": batch.chunk_index, "language": "und", "rel_start_ms": 0,
        "rel_end_ms": batch.end_ms - batch.start_ms, "text": "window " + batch.chunk_index.astype(str), "confidence": 1.0})


TEXT_SCHEMA = "request_id string, response string"


def ask_text(requests: DataFrame, port: Port, concurrency: int | None = None) -> DataFrame:
    """Text-model port: (request_id, prompt) to (request_id, response)."""
    return call_port(requests.select("request_id", "prompt"), port, TEXT_SCHEMA, concurrency)


VISION_SCHEMA = "chapter_id string, observation_id string, frame_ids array<string>, relation string, certainty double"


def look(requests: DataFrame, port: Port | None = None, concurrency: int | None = None) -> DataFrame:
    """Vision port: (chapter_id, frame_ids) to observations; the default sees nothing."""
    return call_port(requests.select("chapter_id", "frame_ids"), port or see_nothing, VISION_SCHEMA, concurrency)


def see_nothing(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({c.split(" ")[0]: pd.Series([], dtype=object) for c in VISION_SCHEMA.split(", ")})


def describe_images(images: DataFrame, port: Port, concurrency: int | None = None) -> DataFrame:
    """Image port: (image_id, content) to (image_id, title, blocks)."""
    return call_port(images.select("image_id", "content"), port, "image_id string, title string, blocks array<string>", concurrency)


def enrich_with_cache(
    requests: DataFrame, cache: DataFrame, port: Port, fingerprint: Column, is_valid: Column, concurrency: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Answer every request, calling the port once per fingerprint the cache lacks.

    Returns ``(answers, new cache rows)``. ``cache`` has (fingerprint, response); of
    several entries the smallest response wins, so a race of two writers is settled the
    same way everywhere, and entries that fail ``is_valid`` count as missing.
    """
    keyed = requests.withColumn("fingerprint", fingerprint)
    known = cache.where(is_valid).groupBy("fingerprint").agg(F.min("response").alias("response"))
    missing = keyed.groupBy("fingerprint").agg(F.min("prompt").alias("prompt")).join(known, "fingerprint", "left_anti")
    asked = missing.select(F.col("fingerprint").alias("request_id"), "prompt")
    fresh = ask_text(asked, port, concurrency).select(F.col("request_id").alias("fingerprint"), "response")
    pool = known.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return keyed.join(pool, "fingerprint", "left"), fresh


def call_with_repair(
    requests: DataFrame, main: Port, repair: Port, is_valid: Column, fallback: Column, concurrency: int | None = None
) -> DataFrame:
    """Main call, one repair of the failures, then the rule-based answer.

    Three passes over ever fewer rows; ``attempts`` and ``outcome`` feed the counters.
    """
    first = requests.join(ask_text(requests, main, concurrency), "request_id", "left").withColumn("ok", F.coalesce(is_valid, F.lit(False)))
    good = first.where("ok").withColumn("outcome", F.lit("MAIN")).withColumn("attempts", F.lit(1))
    failed = first.where("NOT ok").select("request_id", "prompt")
    second = failed.join(ask_text(failed, repair, concurrency), "request_id", "left").withColumn("ok", F.coalesce(is_valid, F.lit(False)))
    settled = second.withColumn("outcome", F.when(F.col("ok"), "REPAIRED").otherwise("FALLBACK")).withColumn("attempts", F.lit(2))
    settled = settled.withColumn("response", F.when(F.col("ok"), F.col("response")).otherwise(fallback))
    columns = ["request_id", "response", "outcome", "attempts"]
    return good.select(*columns).unionByName(settled.select(*columns))


def isolate_frames(requests: DataFrame, frame_targets: DataFrame, target_anchors: DataFrame) -> DataFrame:
    """Split a failed chapter request into one request per frame with only its own targets and anchors.

    ``requests``: chapter_id, frame_ids; ``frame_targets``: chapter_id, frame_id, target_id;
    ``target_anchors``: target_id, anchor_ref.
    """
    frames = requests.select("chapter_id", F.posexplode("frame_ids").alias("ord", "frame_id"))
    targets = frames.join(frame_targets, ["chapter_id", "frame_id"]).groupBy("chapter_id", "frame_id", "ord").agg(
        F.array_sort(F.collect_set("target_id")).alias("target_ids"))
    anchors = frames.join(frame_targets, ["chapter_id", "frame_id"]).join(target_anchors, "target_id").groupBy("chapter_id", "frame_id").agg(
        F.array_sort(F.collect_set("anchor_ref")).alias("anchor_refs"))
    return targets.join(anchors, ["chapter_id", "frame_id"], "left").withColumn(
        "anchor_refs", F.coalesce("anchor_refs", F.array().cast("array<string>")))
