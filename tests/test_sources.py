"""Sources, sinks, ports and streams on small inputs."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanledger.functions import speech, text
from spanledger.operators import compose, ports
from spanledger.sources import captions, datasets, media, publish
from spanledger.streaming import evidence as st


def vtt(spark, content, duration=10_000):
    files = spark.createDataFrame([("f", content, duration, 0, "en")], "file_id string, content string, duration_ms bigint, stream_index int, language string")
    cues, status = captions.parse_webvtt(files)
    return sorted((r.start_ms, r.end_ms, r.text) for r in cues.where("reason = ''").collect()), status.collect()[0].reason


@pytest.mark.parametrize("body,cues,reason", [
    ("WEBVTT\n\n00:01.000 --> 00:02.500\n<b>Hi</b> &amp; bye\nthere\n", [(1000, 2500, "Hi & bye there")], ""),
    ("WEBVTT\n\nid-1\n00:00:01.000 --> 00:00:10.900 line:0\nend\n", [(1000, 10_000, "end")], ""),
    ("WEBVTT\n\n00:01.000 --> 00:12.000\nlate\n", [], "TIMELINE_INVALID"), ("WEBVTT\n\n00:03.000 --> 00:02.000\nback\n", [], "TIMELINE_INVALID"),
    ("00:01.000 --> 00:02.000\nno header\n", [], "VTT_INVALID"), ("WEBVTT\n\nNOTE nothing\n", [], "VTT_INVALID"),
    ("WEBVTT\n\n00:01.000 --> 00:02.000\nbad \x07 bell\n", [], "VTT_INVALID"), ("WEBVTT\n\n00:01.000 --> 00:02.000\n" + "x" * 4001, [], "LIMIT_EXCEEDED"),
    ("WEBVTT\r\n\r\n00:01.000 --> 00:02.000\r\nok\r\n\r\n00:03.000 --> 00:04.000\r\n\r\n", [(1000, 2000, "ok")], ""),
])
def test_webvtt(spark, body, cues, reason):
    assert vtt(spark, body) == (cues, reason)


def test_caption_limits_label_rows(spark):
    files = spark.createDataFrame([("f", "WEBVTT\n\n00:01.000 --> 00:02.000\none\n\n00:03.000 --> 00:04.000\ntwo\n", 10_000, 0, "en")],
                                  "file_id string, content string, duration_ms bigint, stream_index int, language string")
    cues, status = captions.parse_webvtt(files, captions.CaptionLimits(cues=1))
    assert status.first().reason == "LIMIT_EXCEEDED" and [r.reason for r in cues.collect()] == ["LIMIT_EXCEEDED"] * 2


def test_subtitle_ranking(spark):
    rows = [(1, 3, "en", False, True, "subrip"), (1, 4, "zh", True, False, "ass"), (1, 5, "zh", False, False, "webvtt"), (1, 7, "en", True, False, "mov_text"),
            (1, 8, "zh", True, False, "hdmv_pgs_subtitle")]
    df = spark.createDataFrame(rows, "run_id bigint, stream_index bigint, language string, is_default boolean, is_forced boolean, codec string")
    ranked = captions.rank_subtitle_streams(df, ["zh", "en"]).orderBy("rank").collect()
    assert [r.stream_index for r in ranked] == [4, 5, 7, 3]


def test_binary_files_and_jpeg(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    jpeg = bytes.fromhex("FFD8FFE0000400 00FFC4000500 0000FFC0001108 0010 0020".replace(" ", "")) + bytes(20)
    with open(f"{folder}/a.jpg", "wb") as out:
        out.write(jpeg)
    objects = media.read_objects(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "content")
    sizes = {r.filename: (r.width, r.height, r.media_type) for r in media.image_sizes(objects, "content").collect()}
    assert sizes == {"a.jpg": (32, 16, "image/jpeg")}
    rows = objects.unionByName(spark.createDataFrame([("b.jpg", bytearray()), ("c.jpg", bytearray(1001))], "filename string, content binary"))
    assert {r.filename: r.status for r in media.ingest(rows, 1000).collect()} == {"a.jpg": "ACCEPTED", "b.jpg": "EMPTY", "c.jpg": "TOO_LARGE"}


@pytest.mark.parametrize("seconds,ms", [("1.0005", 1001), ("0.0004", 0), ("x", None), ("-1", None), ("NaN", None)])
def test_duration_rounds_half_up(spark, seconds, ms):
    assert spark.createDataFrame([(seconds,)], "s string").select(media.duration_ms(F.col("s")).alias("m")).collect()[0].m == ms


def test_publish_replaces_only_its_partitions(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"
    schema = "tenant string, run_bucket int, run_id bigint, v string"
    publish.publish(spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 2, "keep")], schema), path, ["tenant", "run_bucket"])
    for _ in range(2):
        publish.publish(spark.createDataFrame([("a", 1, 1, "new")], schema), path, ["tenant", "run_bucket"])
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "keep")]


def test_json_lines(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/lines"
    spark.createDataFrame([('{"sample_id":"abc","language":"en"}',), ("  ",), ("{oops",), ('{"sample_id":"x y","language":"en"}',)], "value string").write.text(path)
    rows = datasets.sample_status(datasets.read_json_lines(spark, path, datasets.SAMPLE_SCHEMA)).collect()
    assert sorted(r.status for r in rows) == ["ACCEPTED", "CORRUPT", "INVALID"]


def test_markdown_helpers(spark):
    df = spark.createDataFrame([("- a*b\n1. <x>", "``` and ````")], "t string, code string")
    row = df.select(text.escape_markdown(F.col("t")).alias("e"), text.code_fence(F.col("code")).alias("f"), text.clock(F.lit(3_723_999)).alias("c")).collect()[0]
    assert row.e == "\\- a\\*b\n\\1. &lt;x&gt;" and row.f == "`" * 5 and row.c == "01:02:03"
    numerals = {1: "一", 10: "十", 11: "十一", 20: "二十", 105: "一百零五", 110: "一百一十", 999: "九百九十九", 0: None, 1000: None}
    numbers = spark.createDataFrame([(n,) for n in numerals], "n bigint")
    got = {r.n: r.o for r in numbers.select("n", text.chinese_ordinal(F.col("n")).alias("o")).collect()}
    assert got[11] == "十一" and got[105] == "一百零五" and got[999] == "九百九十九" and got[0] is None and got[1000] is None and got[20] == "二十"


def test_unicode_forms(spark):
    df = spark.createDataFrame([("Straße ＡＢＣ\x1f x",), ("ﬁn",), (None,)], "t string")
    assert [r.n for r in df.select(text.normalize_text(F.col("t")).alias("n")).collect()] == ["strasse abc x", "fin", None]


def test_language_names(spark):
    df = spark.createDataFrame([(" Haitian Creole",), ("zz",), ("Elvish",)], "n string")
    code, warning = speech.recognizer_language(F.col("n"))
    assert [(r.c, r.w) for r in df.select(code.alias("c"), warning.alias("w")).collect()] == [
        ("ht", ""), ("zz", ""), ("und", "CLOUD_ASR_LANGUAGE_UNRECOGNIZED")]
    assert len(speech.LANGUAGE_CODES) == 112


def test_rendered_document(spark):
    titles = spark.createDataFrame([(1, "T*", "")], "run_id bigint, title string, overview string")
    chapters = spark.createDataFrame(
        [(1, 1, 0, 61_000, "One", "same text", "GROUNDED"), (1, 2, 61_000, 90_000, "Two", "", "NO_SEMANTIC_EVIDENCE")],
        "run_id bigint, chapter_index bigint, start_ms bigint, end_ms bigint, title string, summary string, content_status string")
    paragraphs = spark.createDataFrame([(1, 1, 0, "same  text")], "run_id bigint, chapter_index bigint, chunk bigint, text string")
    claims = spark.createDataFrame([(1, 1, 0, "c1"), (1, 1, 1, "c2")], "run_id bigint, chapter_index bigint, pos int, text string")
    got = compose.render_documents(titles, chapters, paragraphs, claims).collect()[0].content
    assert got == (
        "# T\\*\n\n## 核心概览\n\n未提供核心概览。\n\n## 目录\n\n- 第一章：One （00:00:00 - 00:01:01）\n- 第二章：Two （00:01:01 - 00:01:30）\n\n"
        "## 第一章：One\n\n时间：00:00:00 - 00:01:01\n\nsame  text\n\n#### 本章结论\n\n- c1\n- c2\n\n## 第二章：Two\n\n时间：00:01:01 - 00:01:30\n")


def test_cache_calls_each_fingerprint_once(spark):
    requests = spark.createDataFrame([(str(i), f"p{i % 3}") for i in range(9)], "request_id string, prompt string")
    cache = spark.createDataFrame([("p0", "known"), ("p1", "")], "fingerprint string, response string")

    def port(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"request_id": batch.request_id, "response": "new " + batch.prompt})

    answers, fresh = ports.enrich_with_cache(requests, cache, port, F.col("prompt"), F.length("response") > 0)
    assert sorted(r.fingerprint for r in fresh.collect()) == ["p1", "p2"]
    assert {(r.prompt, r.response) for r in answers.collect()} == {("p0", "known"), ("p1", "new p1"), ("p2", "new p2")}


def test_dedup_across_micro_batches(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "run_id bigint, evidence_id string, text string, confidence double, start_ms bigint, end_ms bigint"
    rows = [(1, "a", "x", 0.2, 0, 10), (1, "b", "x", 0.5, 10, 20), (1, "c", "x", 0.1, 20, 30), (1, "d", "x", 0.1, 30, 40), (1, "e", "y", 0.1, 40, 50)]
    for i, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    kept = st.settle_slots(st.run_available(st.incremental_dedup(stream)))
    assert sorted(r.evidence_id for r in kept.collect()) == ["b", "d", "e"]


def test_streamed_files_are_judged(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/clip.mp4", "wb") as out:
        out.write(bytes.fromhex("0000001866747970") + b"isom" + bytes(40))
    files = media.stream_objects(spark, folder)
    objects = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"), F.lit("video/mp4").alias("declared_mime"), "content")
    assert [r.verdict for r in st.run_available(st.intake(objects, 1000, "video")).collect()] == ["ACCEPTED"]
