"""What the larger tables hold and the smallest ones do not."""

import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanledger.operators import folds, quality, rendering
from spanledger.sources import media


def test_stream_over_a_folder_of_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(1, 9)], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "pages.parquet")
    for form in ("folder", "file"):
        got = entry.queries()["str1_object_intake"](spark, str(tmp_path / form)).collect()
        assert sorted((r.page_id, r.size_bytes) for r in got) == [(i, i) for i in range(1, 9)]


def test_caption_of_a_page_cut_within_an_entity(spark, tmp_path):
    """The SQL decodes whole entities only; the operator, as the reference, also those without a semicolon."""
    html = "<title>a &amp;&amp</title> b &am &lt;i&gt; &amp;lt; &quot;"
    spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["f4_caption_text"](spark, str(tmp_path)).collect()
    assert [r.caption for r in got] == ['<title>a &&amp</title> b &am <i> &lt; "']


def test_audio_of_zero_length(spark):
    payload = '{"format":{"duration":"0.0"},"streams":[{"sample_rate":"44100","channels":2,"codec_name":"mp3"}]}'
    probes = spark.createDataFrame([(1, payload)], "event_id bigint, payload string")
    one = lambda **how: media.parse_audio_probe(probes, "payload", 300_000, **how).first()
    assert (one().status, one().duration_ms) == ("PROBE_INVALID", None)
    assert (one(zero_length=True).status, one(zero_length=True).duration_ms) == ("ACCEPTED", 0)


def test_a_fold_merges_without_a_call_for_every_key(spark):
    rows = spark.range(6).selectExpr("id % 3 AS run_id", "repeat('x', int(id)) AS text")
    out = folds.fold_by_key(rows, ["run_id"], folds.longest_texts(1))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert sorted((r.run_id, r.rows, r.chars) for r in out.collect()) == [(0, 2, 3), (1, 2, 5), (2, 2, 7)]


def test_long_distances_by_bit_vectors(spark, monkeypatch):
    """Exact in bands and without them, over the built-in function's characters; a band is entered only by texts that are alike."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(200, 700))) for _ in range(30)]
    pairs = [(a, a[rng.randrange(9):] + "xyz") for a in texts] + list(zip(texts, texts[1:], strict=False)) + [("", "abc" * 90), (None, "a")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    want = [r[0] for r in frame.select(F.levenshtein("a", "b").cast("bigint")).collect()]
    assert [r[0] for r in frame.select(quality.edit_distance(F.col("a"), F.col("b"))).collect()] == want
    for band in (2, 16, 10_000):
        monkeypatch.setattr(quality, "BAND", band)
        assert [quality.bit_distance(a, b) for a, b in pairs[:-1]] == want[:-1]


@pytest.mark.parametrize("name", ["t12_audio_documents", "t12_block_documents"])
def test_documents_of_a_hundred_chapters_and_more(spark, tmp_path, name):
    """The SQL leaves hundreds out of the number of a chapter; the operator, as the reference, writes them."""
    lines = [(1, 8 * 99), (2, 8 * 99 + 1), (3, 8 * 114), (4, 8 * 231), (5, 8 * 1001)]
    rows = [(i, "\n".join(f"line {k}. an e x" for k in range(n)), "en", "web") for i, n in lines]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name], connection)[1:] == (5, "ok")


@pytest.mark.parametrize("render", [rendering.render_audio, rendering.render_video])
def test_hundreds_are_written_by_default(spark, render):
    titles = spark.createDataFrame([(1, "t", "o")], "run_id int, title string, overview string")
    chapters = spark.createDataFrame([(1, c, 0, 1000, "t", "s", "GROUNDED") for c in (10, 100, 114)], "run_id int, chapter_index int, start_ms int, end_ms int, title string, summary string, content_status string")
    blocks = spark.createDataFrame([], f"run_id int, chapter_index int, position int, block struct<{','.join(f'{n}:{k}' for n, k in rendering.BLOCK.items())}>")
    claims = spark.createDataFrame([], "run_id int, chapter_index int, pos int, text string")
    content = render(titles, chapters, blocks, claims).first().content
    assert [x for x in content.split("\n") if x.startswith("## 第")] == ["## 第十章：t", "## 第一百章：t", "## 第一百十四章：t"]
