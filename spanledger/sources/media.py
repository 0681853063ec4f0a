"""Media objects: digest, content signature, naming rules, image and container headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanledger.functions.speech import lookup, subtitle_language

HEADER_BYTES = 4096
# File extensions and their media types.
VIDEO_TYPES = {"mp4": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm"}
AUDIO_TYPES = {
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg",
    "flac": "audio/flac", "webm": "audio/webm",
}
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
TYPES = {"video": VIDEO_TYPES, "audio": AUDIO_TYPES, "image": IMAGE_TYPES}


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded objects as rows of path, length and content."""
    return spark.read.format("binaryFile").load(path)


def stream_objects(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded objects as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path)


def ingest(objects: DataFrame, max_bytes: int) -> DataFrame:
    """Size, digest and header of each object, with EMPTY and TOO_LARGE as a status."""
    size = F.octet_length("content").cast("bigint")
    status = F.when(size == 0, "EMPTY").when(size > max_bytes, "TOO_LARGE").otherwise("ACCEPTED")
    return objects.select(
        *[c for c in objects.columns if c != "content"], size.alias("size_bytes"), F.sha2(F.col("content"), 256).alias("sha256"),
        F.substring("content", 1, HEADER_BYTES).alias("header"), status.alias("status"),
    )


def sniff(header: Column, kind: str) -> Column:
    """Media type from the leading bytes, null when unknown."""
    code = F.hex(F.substring(header, 1, 12))
    at = lambda offset, n: F.substring(code, offset * 2 + 1, n * 2)
    full = F.length(code) >= 24
    box = full & (at(4, 4) == "66747970")
    if kind == "video":
        webm = F.contains(F.lower(F.decode(header, "ISO-8859-1")), F.lit("webm"))
        return (
            F.when(box & (at(8, 2) == "7174"), "video/quicktime").when(box, "video/mp4")
            .when((at(0, 4) == "1A45DFA3") & webm, "video/webm").when(at(0, 4) == "1A45DFA3", "video/x-matroska")
        )
    if kind == "audio":
        return (
            F.when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "audio/wav")
            .when((at(0, 3) == "494433") | (at(0, 2) == "FFFB"), "audio/mpeg").when(at(0, 4) == "664C6143", "audio/flac")
            .when(at(0, 4) == "4F676753", "audio/ogg").when(box, "audio/mp4")
        )
    return (
        F.when(at(0, 3) == "FFD8FF", "image/jpeg").when(at(0, 8) == "89504E470D0A1A0A", "image/png")
        .when(full & (at(0, 4) == "52494646") & (at(8, 4) == "57454250"), "image/webp")
    )


def name_verdict(filename: Column, declared: Column, detected: Column, kind: str) -> Column:
    """ACCEPTED or the first naming rule the upload breaks."""
    extension = F.lower(F.regexp_extract(filename, r"^.+[.]([^.]+)$", 1))
    expected = lookup(TYPES[kind], extension)
    bad_name = (filename == "") | filename.rlike(r"/|\x00") | filename.isin(".", "..")
    return (
        F.when(filename.isNull() | bad_name, "INVALID_FILENAME").when(expected.isNull(), "FORMAT_UNSUPPORTED")
        .when(~declared.eqNullSafe(expected), "MIME_MISMATCH").when(~detected.eqNullSafe(declared), "CONTENT_MISMATCH")
        .otherwise("ACCEPTED")
    )


# Fixed value: JPEG markers that open a frame header.
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _jpeg_size(data: bytes) -> str | None:
    """``WxH`` from the first frame header of a JPEG."""
    at = 2
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 9:
        kind, size = struct.unpack_from(">BH", data, at + 1)
        if kind in (0xD8, 0xD9):
            at += 2
        elif size < 2 or at + 2 + size > len(data):
            return None
        elif kind in JPEG_FRAMES:
            high, wide = struct.unpack_from(">HH", data, at + 5)
            return f"{wide}x{high}" if size >= 7 else None
        else:
            at += 2 + size
    return None


@F.pandas_udf(StringType())
def _jpeg_sizes(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else _jpeg_size(bytes(data)))


def image_sizes(images: DataFrame, content: str) -> DataFrame:
    """Add ``width``, ``height`` and ``media_type``; null when unreadable or out of 1..20000 pixels.

    PNG and WEBP are read with built-in expressions; only JPEG bytes go to Python.
    """
    rows = images.withColumn("__code", F.hex(F.substring(content, 1, 30))).withColumn("__kind", sniff(F.col(content), "image"))
    code, kind, chunk = F.col("__code"), F.col("__kind"), F.substring("__code", 25, 8)
    rows = rows.withColumn("__jpeg", _jpeg_sizes(F.when(kind == "image/jpeg", F.col(content))))
    form = (
        F.when((kind == "image/png") & (F.length(code) >= 48), "png").when(kind == "image/jpeg", "jpeg")
        .when((kind == "image/webp") & (F.length(code) >= 60) & (chunk == "56503858"), "vp8x")
        .when((kind == "image/webp") & (F.length(code) >= 60) & (chunk == "56503820"), "vp8"))
    # Byte offset, byte count and byte order of width and height per form.
    places = {"png": ((16, 20), 4, False), "vp8x": ((24, 27), 3, True), "vp8": ((26, 28), 2, True)}
    rows = rows.withColumn("__form", form)
    for side, name in enumerate(("__w", "__h")):
        digits = F.lit(None).cast("string")
        for key, (offsets, count, little) in places.items():
            order = range(count - 1, -1, -1) if little else range(count)
            picked = F.concat(*[F.substring(code, (offsets[side] + i) * 2 + 1, 2) for i in order])
            digits = F.when(F.col("__form") == key, picked).otherwise(digits)
        rows = rows.withColumn(name + "x", digits)
        number = F.conv(F.col(name + "x"), 16, 10).cast("bigint")
        value = (
            F.when(F.col("__form") == "jpeg", F.split("__jpeg", "x")[side].cast("bigint"))
            .when(F.col("__form") == "vp8x", number + 1).when(F.col("__form") == "vp8", number.bitwiseAND(F.lit(0x3FFF)))
            .otherwise(number))
        rows = rows.withColumn(name, value)
    valid = F.col("__w").between(1, 20_000) & F.col("__h").between(1, 20_000)
    return rows.select(
        *images.columns, F.when(valid, F.col("__w")).alias("width"), F.when(valid, F.col("__h")).alias("height"),
        F.when(valid, kind).alias("media_type"))


STREAM = (
    "struct<index:bigint,codec_type:string,codec_name:string,width:bigint,height:bigint,avg_frame_rate:string,"
    "r_frame_rate:string,pix_fmt:string,sample_rate:string,channels:bigint,duration:string,tags:struct<rotate:string,language:string>,"
    "disposition:struct<default:int,forced:int>,side_data_list:array<struct<rotation:bigint>>>"
)
PROBE_SCHEMA = f"struct<format:struct<duration:string,format_name:string>,streams:array<{STREAM}>>"


def duration_ms(seconds: Column) -> Column:
    """Decimal seconds to milliseconds, half up; null when not a positive number."""
    value = seconds.try_cast("decimal(24,9)")
    return F.when(value > 0, F.round(value * 1000, 0).cast("bigint"))


def _rate(text: Column) -> tuple[Column, Column]:
    return F.split(text, "/")[0].try_cast("bigint"), F.split(text, "/")[1].try_cast("bigint")


def parse_probe(
    probes: DataFrame, payload: str, max_duration_ms: int = 7_200_000, max_side: int = 3840, max_fps: float = 120.0,
    max_streams: int = 8,
) -> DataFrame:
    """Container probe JSON to one manifest row: timeline, video stream, flags and status."""
    root = F.from_json(payload, PROBE_SCHEMA)
    rows = probes.withColumn("__p", root)
    streams = F.coalesce(F.col("__p.streams"), F.array().cast(f"array<{STREAM}>"))
    of = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    rows = rows.withColumn("__v", of("video")).withColumn("__a", of("audio")).withColumn("__s", of("subtitle"))
    video = F.get("__v", F.lit(0))
    container = duration_ms(F.col("__p.format.duration"))
    stream_ms = F.when(video["duration"] != "N/A", duration_ms(video["duration"]))
    side = F.get(F.filter(video["side_data_list"], lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"]
    rotation = F.pmod(F.coalesce(side, video["tags"]["rotate"].try_cast("bigint"), F.lit(0)), F.lit(360))
    turned = rotation.isin(90, 270)
    wide, high = F.when(turned, video["height"]).otherwise(video["width"]), F.when(turned, video["width"]).otherwise(video["height"])
    an, ad = _rate(video["avg_frame_rate"])
    rn, rd = _rate(video["r_frame_rate"])
    average, nominal = F.try_divide(an, ad), F.try_divide(rn, rd)
    gap = F.greatest(F.lit(0.001), F.greatest(F.abs(average), F.abs(nominal)) * 0.001)
    status = (
        F.when(F.size("__v") == 0, "VIDEO_STREAM_MISSING")
        .when(F.greatest(F.size("__v"), F.size("__a"), F.size("__s")) > max_streams, "STREAM_COUNT_EXCEEDED")
        .when(container.isNull(), "PROBE_INVALID")
        .when((container > max_duration_ms) | F.coalesce(stream_ms > max_duration_ms, F.lit(False)), "DURATION_EXCEEDED")
        .when(~rotation.isin(0, 90, 180, 270) | average.isNull() | (average <= 0) | nominal.isNull(), "PROBE_INVALID")
        .when((wide > max_side) | (high > max_side), "RESOLUTION_EXCEEDED").when(average > max_fps, "FRAME_RATE_EXCEEDED")
        .otherwise("ACCEPTED")
    )
    keep = [c for c in probes.columns if c != payload]
    return rows.select(
        *keep, status.alias("status"), container.alias("duration_ms"), F.coalesce(stream_ms, container).alias("timeline_ms"),
        wide.alias("display_width"), high.alias("display_height"), rotation.alias("rotation"),
        (F.abs(average - nominal) > gap).alias("is_variable_rate"), F.size("__a").cast("bigint").alias("audio_streams"),
        F.array_join(F.transform("__s", lambda s: subtitle_language(s["tags"]["language"])), ",").alias("subtitle_languages"),
        F.when(F.size("__a") == 0, "NO_AUDIO_TRACK").otherwise("").alias("warning"),
    )


def parse_audio_probe(probes: DataFrame, payload: str, max_duration_ms: int, zero_length: bool = False) -> DataFrame:
    """Audio probe JSON to duration (banker's rounding), rate, channels and codec; a duration of zero is invalid unless ``zero_length``."""
    root = F.from_json(payload, PROBE_SCHEMA)
    stream = F.get(root["streams"], F.lit(0))
    seconds = root["format"]["duration"].try_cast("double")
    ms = F.when(((seconds >= 0) if zero_length else (seconds > 0)) & (seconds < 1e15), F.bround(seconds * 1000, 0).cast("bigint"))
    rate = stream["sample_rate"].try_cast("bigint")
    valid = ms.isNotNull() & (rate >= 1) & (stream["channels"] >= 1) & stream["codec_name"].isNotNull()
    status = (
        F.when(seconds * 1000 > max_duration_ms, "DURATION_EXCEEDED")
        .when(F.coalesce(valid, F.lit(False)), "ACCEPTED").otherwise("PROBE_INVALID")
    )
    keep = [c for c in probes.columns if c != payload]
    return probes.select(
        *keep, status.alias("status"), ms.alias("duration_ms"), rate.alias("sample_rate"), stream["channels"].alias("channels"),
        stream["codec_name"].alias("codec_name"), F.coalesce(root["format"]["format_name"], F.lit("audio")).alias("format_name"),
    )


# Fixed values of the audio size estimate.
AUDIO_BYTES_PER_SECOND = 24_000
AUDIO_OVERHEAD_BYTES = 65_536


def capacity_profile(
    media: DataFrame, proxy_rate: int, max_proxy: int, window_ms: int, other_bytes: int, available_bytes: int
) -> DataFrame:
    """Bytes a run needs on disk and whether they are available."""
    def audio(ms: Column) -> Column:
        return F.floor((ms * AUDIO_BYTES_PER_SECOND + 999) / 1000).cast("bigint") + AUDIO_OVERHEAD_BYTES

    seconds = F.floor((F.col("duration_ms") + 999) / 1000)
    sized = media.withColumn("proxy_bytes", F.least(seconds * proxy_rate, F.lit(max_proxy)).cast("bigint")).withColumn(
        "audio_bytes", audio(F.col("duration_ms")))
    need = F.col("proxy_bytes") * 2 + F.col("audio_bytes") + audio(F.lit(window_ms).cast("bigint")) + other_bytes
    return sized.withColumn("required_bytes", need).withColumn("fits", need <= available_bytes).drop("duration_ms")
