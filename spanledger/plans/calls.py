"""Queries over the pluggable calls, with deterministic stand-ins for the models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanledger.functions import text as tx
from spanledger.operators import folds, generate, ports, selection, spans
from spanledger.plans.catalog import query
from spanledger.plans.documents import chapters_of


def shout(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in text model: the prompt's length and its first word."""
    words = batch.prompt.str.split(n=1).str[0].fillna("")
    return pd.DataFrame({"request_id": batch.request_id, "response": batch.prompt.str.len().astype(str) + ":" + words})


def repair(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"request_id": batch.request_id, "response": (batch.prompt.str.len() // 2).astype(str) + ":fixed"})


def turn_requests(t):
    return t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("request_id"), F.col("text").alias("prompt"))


@query("u1_transcription", """
SELECT run_id, k AS chunk_index, k * 600000 AS start_ms, least(duration_ms, (k + 1) * 600000) AS end_ms, 'window ' || k AS text, '' AS warning
FROM (SELECT run_id, duration_ms, unnest(range(0, (duration_ms + 599999) // 600000)) AS k FROM v_runs)""", "v_runs")
def _(t):
    windows = generate.fixed_windows(t.v_runs, "run_id", "duration_ms", 600_000)
    heard = ports.transcribe(windows).join(
        windows.select("run_id", "chunk_index", F.col("start_ms").alias("window_start_ms"), F.col("end_ms").alias("window_end_ms")), ["run_id", "chunk_index"])
    return spans.project_windows(heard).select("run_id", "chunk_index", "start_ms", "end_ms", "text", "warning")


@query("u2_text_model", "SELECT conv_id || '_' || turn AS request_id, length(text) || ':' || regexp_extract(text, '\\S+') AS response FROM conversations")
def _(t):
    return ports.ask_text(turn_requests(t), shout)


@query("u3_vision_default", "SELECT CAST(NULL AS VARCHAR) AS chapter_id, CAST(NULL AS VARCHAR) AS observation_id, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS DOUBLE) AS certainty FROM lineitem WHERE l_orderkey < 0")
def _(t):
    frames = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("chapter_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("frame_ids"))
    return ports.look(frames).drop("frame_ids")


@query("u3_vision_model", """
SELECT l_orderkey || '' AS chapter_id, 'obs_' || l_orderkey AS observation_id, 'SUPPORTING' AS relation, round(1.0 / count(DISTINCT l_suppkey), 9) AS certainty FROM lineitem GROUP BY l_orderkey""")
def _(t):
    def observe(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch.frame_ids.map(len)
        return pd.DataFrame({"chapter_id": batch.chapter_id, "observation_id": "obs_" + batch.chapter_id, "frame_ids": batch.frame_ids,
                             "relation": "SUPPORTING", "certainty": (1.0 / sizes).round(9)})

    frames = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("chapter_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("frame_ids"))
    return ports.look(frames, observe).drop("frame_ids")


@query("u4_image_analyzer", "SELECT page_id || '' AS image_id, 'image of ' || strlen(html) || ' bytes' AS title, CAST(2 AS BIGINT) AS blocks FROM pages")
def _(t):
    def describe(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch.content.map(len)
        return pd.DataFrame({"image_id": batch.image_id, "title": "image of " + sizes.astype(str) + " bytes", "blocks": [["a", "b"]] * len(batch)})

    images = t.pages.select(F.col("page_id").cast("string").alias("image_id"), F.encode("html", "UTF-8").alias("content"))
    return ports.describe_images(images, describe).select("image_id", "title", F.size("blocks").cast("bigint").alias("blocks"))


@query("u5_cached_enrichment", """
WITH c AS (SELECT sha256(text) AS fp, min(length(text) || ':cached') AS response FROM conversations WHERE turn % 3 = 0 GROUP BY 1)
SELECT conv_id || '_' || turn AS request_id, coalesce(c.response, length(text) || ':' || regexp_extract(text, '\\S+')) AS response, c.fp IS NOT NULL AS cache_hit FROM conversations LEFT JOIN c ON c.fp = sha256(text)""")
def _(t):
    cache = t.conversations.where("turn % 3 = 0").select(
        F.sha2("text", 256).alias("fingerprint"), F.concat(F.length("text"), F.lit(":cached")).alias("response"))
    answers, _ = ports.enrich_with_cache(turn_requests(t), cache, shout, F.sha2("prompt", 256), F.col("response").rlike("^[0-9]+:"))
    return answers.select("request_id", "response", "cache_hit")


@query("u6_repair_ladder", """
WITH a AS (SELECT conv_id || '_' || turn AS request_id, length(text) AS n, text FROM conversations)
SELECT request_id, CASE WHEN n % 3 <> 0 THEN n || ':' || regexp_extract(text, '\\S+') WHEN (n // 2) % 3 <> 0 THEN n // 2 || ':fixed' ELSE 'rule ' || n END AS response,
       CASE WHEN n % 3 <> 0 THEN 'MAIN' WHEN (n // 2) % 3 <> 0 THEN 'REPAIRED' ELSE 'FALLBACK' END AS outcome, CASE WHEN n % 3 <> 0 THEN 1 ELSE 2 END AS attempts FROM a""")
def _(t):
    good = F.split("response", ":")[0].cast("bigint") % 3 != 0
    return ports.call_with_repair(turn_requests(t), shout, repair, good, F.concat(F.lit("rule "), F.length("prompt")))


@query("u7_frame_isolation", """
WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem)
SELECT l_orderkey || '' AS chapter_id, l_suppkey || '' AS frame_id, string_agg(DISTINCT l_partkey || '', ',' ORDER BY l_partkey || '') AS target_ids,
       coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS anchor_refs FROM f LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_suppkey""")
def _(t):
    s = lambda c: F.col(c).cast("string")
    requests = t.lineitem.groupBy(s("l_orderkey").alias("chapter_id")).agg(F.array_sort(F.collect_set(s("l_suppkey"))).alias("frame_ids"))
    targets = t.lineitem.select(s("l_orderkey").alias("chapter_id"), s("l_suppkey").alias("frame_id"), s("l_partkey").alias("target_id")).distinct()
    anchors = t.part.select(s("p_partkey").alias("target_id"), F.col("p_brand").alias("anchor_ref"))
    out = ports.isolate_frames(requests, targets, anchors)
    return out.select("chapter_id", "frame_id", F.array_join("target_ids", ",").alias("target_ids"), F.array_join("anchor_refs", ",").alias("anchor_refs"))


@query("u8_bounded_folds", """
SELECT run_id, count(*) AS rows_in, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_sentences GROUP BY run_id""", "v_sentences")
def _(t):
    packed = selection.pack_batches(t.v_sentences.select("run_id", "seq", "text"), ["run_id"], "seq", 24, 1500, 1600)
    batches = packed.groupBy("run_id", "batch_start").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return batches.groupBy("run_id").agg(F.sum("n").alias("rows_in"), F.sum("c").alias("chars"))


@query("u9_generators", """
SELECT run_id, chunk_index + 1 AS chapter_index, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS opens FROM v_windows""", "v_windows")
def _(t):
    return chapters_of(t).select("run_id", "chapter_index", tx.clock(F.col("start_ms")).alias("opens"))


@query("u8_merged_folds", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY length(text) DESC, text) AS n FROM v_sentences)
SELECT run_id, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(text, chr(10) ORDER BY n) FILTER (n <= 3)) AS longest FROM r GROUP BY run_id""", "v_sentences")
def _(t):
    out = folds.fold_by_key(t.v_sentences.select("run_id", "text"), ["run_id"], folds.longest_texts(3))
    return out.select("run_id", "rows", "chars", F.sha2(F.array_join("longest", "\n"), 256).alias("longest"))


@query("u9_table_function", """
WITH n AS (SELECT run_id, evidence_id, role, start_ms, lag(evidence_id) OVER w AS before, lag(end_ms) OVER w AS ended, lag(role) OVER w AS spoke FROM v_transcript WINDOW w AS (PARTITION BY run_id ORDER BY start_ms, evidence_id))
SELECT run_id, before AS from_ref, evidence_id AS to_ref, start_ms - ended AS pause_ms, role <> spoke AS turned FROM n WHERE start_ms > ended""", "v_transcript")
def _(t):
    return folds.pauses(t.spark, t.v_transcript)
