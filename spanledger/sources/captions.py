"""Subtitle tracks: ranking, WebVTT files to cues, sufficiency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.identity import stable_id
from spanledger.functions.text import caption_text
from spanledger.operators.scan import Scan, ordered_scan

# Fixed values of the subtitle rules.
TEXT_CODECS = ["subrip", "ass", "ssa", "webvtt", "mov_text"]
HINT_LANGUAGES = ["zh", "en", "ja", "ko", "es"]
OVERRUN_MS = 1_000


@dataclass(frozen=True)
class CaptionLimits:
    """Limits of a caption file; what exceeds one is labelled LIMIT_EXCEEDED."""

    file_bytes: int = 16 * 1024 * 1024
    cues: int = 20_000
    cue_chars: int = 4_000
    total_chars: int = 2_000_000


def rank_subtitle_streams(streams: DataFrame, hints: list[str]) -> DataFrame:
    """Rank the text streams of each run: hinted language, default, not forced, index.

    The rank is an ordered scan whose slices follow the whole sort key, so a run with
    very many streams is not sorted in one task.
    """
    position = F.lit(999)
    for place, language in reversed(list(enumerate(hints))):
        if language in HINT_LANGUAGES:
            position = F.when(F.col("language") == language, F.lit(place)).otherwise(position)
    text = streams.where(F.lower("codec").isin(TEXT_CODECS)).select(
        "run_id", "stream_index", position.alias("p"),
        F.when(F.col("is_default"), 0).otherwise(1).alias("d"), F.when(F.col("is_forced"), 1).otherwise(0).alias("f"),
    )
    first = text.groupBy("run_id", "stream_index").agg(F.min(F.struct("p", "d", "f")).alias("k")).select(
        "run_id", "stream_index", "k.p", "k.d", "k.f")
    bucket = F.struct("p", "d", "f", F.floor(F.col("stream_index") / 4096).alias("part"))
    ranked = ordered_scan(first, ["run_id"], ["p", "d", "f", "stream_index"], bucket, [Scan("before", "count_before")])
    return ranked.select("run_id", "stream_index", (F.col("before") + 1).alias("rank"))


def subtitle_sufficiency(
    cues: DataFrame, runs: DataFrame, keys: list[str], min_ratio: float = 0.8, cue_ms: int | None = 30_000
) -> DataFrame:
    """Whether a track carries enough text, cues and time span to stand in for speech recognition."""
    totals = cues.groupBy(*keys).agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("cues"),
        (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
    ).join(runs.select("run_id", "duration_ms"), "run_id")
    duration = F.col("duration_ms")
    need_cues = F.lit(1) if cue_ms is None else F.greatest(F.lit(1), F.ceil(duration / cue_ms))
    eligible = (
        (F.col("chars") >= F.ceil(F.greatest(F.lit(20.0), duration * 24.0 / 60000.0)))
        & (F.col("cues") >= need_cues) & (F.col("span_ms") / duration >= min_ratio)
    )
    return totals.withColumn("eligible", eligible)


def first_eligible(tracks: DataFrame) -> DataFrame:
    """Best eligible track per run and how many better-ranked ones were rejected."""
    best = tracks.groupBy("run_id").agg(F.min(F.when(F.col("eligible"), F.col("rank"))).alias("chosen"))
    rejected = ~F.col("eligible") & (F.col("chosen").isNull() | (F.col("rank") < F.col("chosen")))
    return tracks.join(best, "run_id").groupBy("run_id").agg(
        F.max("chosen").alias("chosen"), F.sum(F.when(rejected, 1).otherwise(0)).alias("rejected_before"))


_TIME = r"(?:(\d+):)?(\d{2}):(\d{2})[.](\d{3})"
_TIMING = rf"(?m)^[ \t]*{_TIME}[ \t]+-->[ \t]+{_TIME}.*$"


def _clock_ms(stamp: Column) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(stamp, _TIME, i), F.lit("")), F.lit("0")).cast("bigint")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def parse_webvtt(files: DataFrame, limits: CaptionLimits = CaptionLimits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """WebVTT files to ``(cues, file status)``.

    ``files``: file_id, content, duration_ms, stream_index, language. Every cue is returned with the first rule
    its file breaks as ``reason`` (empty when none); limits are per file and found by one aggregation.
    """
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n")
    headed = files.withColumn("__text", text).withColumn("__ok", F.col("__text").rlike(r"^WEBVTT(?:[ \t\n]|$)"))
    blocks = headed.where("__ok").select(
        "file_id", "duration_ms", "stream_index", "language", F.posexplode(F.split("__text", r"\n[ \t]*\n\s*")).alias("pos", "block")
    ).where(F.col("block").rlike(_TIMING))
    timed = blocks.withColumn("__line", F.regexp_extract("block", _TIMING, 0))
    after = F.locate("-->", F.col("block")) + F.length(F.substring_index("__line", "-->", -1)) + 3
    payload = F.regexp_replace(F.substring(F.col("block"), after, F.length("block")), "<[^>]*>", "")
    rows = timed.select(
        "file_id", "duration_ms", "stream_index", "language", "pos", caption_text(payload).alias("text"),
        _clock_ms(F.substring_index("__line", "-->", 1)).alias("start_ms"), _clock_ms(F.substring_index("__line", "-->", -1)).alias("raw_end_ms"),
    )
    bad_time = (
        (F.col("start_ms") >= F.col("raw_end_ms")) | (F.col("start_ms") >= F.col("duration_ms"))
        | (F.col("raw_end_ms") > F.col("duration_ms") + OVERRUN_MS)
    )
    rows = rows.withColumn("reason", F.when(F.col("text") == "", F.lit(None)).when(F.col("text").isNull(), "VTT_INVALID")
                           .when(F.length("text") > limits.cue_chars, "LIMIT_EXCEEDED").when(bad_time, "TIMELINE_INVALID"))
    spoken = ~F.col("text").eqNullSafe("")
    facts = rows.groupBy("file_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "reason")))["reason"].alias("first_bad"),
        F.nullif(F.sum(F.when(spoken, 1).otherwise(0)), F.lit(0)).alias("cues"), F.sum(F.length("text")).alias("chars"),
        (F.max(F.when(spoken, F.least("raw_end_ms", "duration_ms"))) - F.min(F.when(spoken, F.col("start_ms")))).alias("span_ms"),
    )
    status = headed.select("file_id", "duration_ms", "__ok", (F.octet_length("content") > limits.file_bytes).alias("__big")).join(
        facts, "file_id", "left"
    ).withColumn(
        "reason",
        F.when(F.col("__big"), "LIMIT_EXCEEDED").when(~F.col("__ok") | F.col("cues").isNull(), "VTT_INVALID")
        .when(F.col("first_bad").isNotNull(), F.col("first_bad"))
        .when((F.col("cues") > limits.cues) | (F.col("chars") > limits.total_chars), "LIMIT_EXCEEDED").otherwise(""),
    ).select("file_id", "cues", "chars", (F.col("span_ms") / F.col("duration_ms")).alias("span_ratio"), "reason")
    judged = rows.drop("reason").join(status.select("file_id", "reason"), "file_id")
    end = F.least("raw_end_ms", "duration_ms")
    cues = judged.select(
        "file_id", stable_id("subtitle", file_id=F.col("file_id"), stream_index=F.col("stream_index"), start_ms=F.col("start_ms"),
                             end_ms=end, text=F.col("text")).alias("evidence_id"),
        "start_ms", end.alias("end_ms"), "text", "language", "stream_index", "reason",
    ).where("NOT (text <=> '')")
    return cues, status
