"""Streaming queries, run over everything available and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions.timing import epoch_ms
from spanledger.operators.spans import project_windows
from spanledger.plans.catalog import query
from spanledger.plans.timeline import _TOUCHING, touching
from spanledger.plans.views import EPOCH_2024_MS
from spanledger.session import stage_table
from spanledger.streaming import evidence as st


def span_stream(t):
    rows = st.read_table_stream(t.spark, t.folder, "events")
    start = epoch_ms(F.col("ts")) - EPOCH_2024_MS
    length = F.greatest(F.round(F.col("value") * 100).cast("bigint") * 600, F.lit(1).cast("bigint"))
    return rows.select(F.col("user_id").alias("run_id"), "event_id", "event_type", start.alias("start_ms"), (start + length).alias("end_ms"))


@query("str1_object_intake", """
SELECT page_id, strlen(html) AS size_bytes, sha256(html) AS sha256, CASE WHEN strlen(html) > 4000 THEN 'TOO_LARGE' WHEN page_id % 2 = 0 THEN 'FORMAT_UNSUPPORTED' ELSE 'CONTENT_MISMATCH' END AS verdict FROM pages""")
def _(t):
    pages = st.read_table_stream(t.spark, t.folder, "pages")
    objects = pages.select(
        "page_id", F.when(F.col("page_id") % 2 == 0, "a.html").otherwise("a.mp4").alias("filename"), F.lit("video/mp4").alias("declared_mime"),
        F.encode("html", "UTF-8").alias("content"))
    return st.run_available(st.intake(objects, 4000, "video")).select("page_id", "size_bytes", "sha256", "verdict")


@query("str2_session_spans", """
WITH isl AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER w <= 600000 THEN 0 ELSE 1 END AS opens FROM v_spans
        WINDOW w AS (PARTITION BY run_id ORDER BY start_ms, end_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
num AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM isl)
SELECT run_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM num GROUP BY run_id, isle""", "v_spans")
def _(t):
    return st.run_available(st.session_spans(span_stream(t), 600_000), "complete")


@query("str3_tumbling_windows", "SELECT run_id, start_ms // 600000 * 600000 AS start_ms, count(*) AS n FROM v_spans GROUP BY ALL", "v_spans")
def _(t):
    return st.run_available(st.tumbling_counts(span_stream(t)), "complete")


def request_stream(t):
    rows = st.read_table_stream(t.spark, t.folder, "events")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"), F.col("event_type").alias("scope"), F.col("user_id").alias("key"), F.col("props").alias("payload"))


@query("str4_first_requests", "SELECT event_type AS scope, user_id AS key, props AS payload, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL")
def _(t):
    once = st.run_available(st.first_requests(request_stream(t), "40 days"))
    return once.groupBy("scope", "key", "payload").agg(F.count(F.lit(1)).alias("n"))


@query("str4_conflicts", """
WITH f AS (SELECT event_id, props, first_value(props) OVER w AS stored, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id))
SELECT event_id AS request_id, CASE WHEN rn = 1 THEN 'NEW' WHEN props = stored THEN 'REUSED' ELSE 'CONFLICT' END AS outcome FROM f""")
def _(t):
    return st.flag_conflicts(request_stream(t))


@query("str5_expired_leases", """
WITH n AS (SELECT job_id, event_id, status, epoch_us(lease_expires_at) // 1000 AS lease, lead(epoch_us(ts) // 1000) OVER (PARTITION BY job_id ORDER BY epoch_us(ts) // 1000, event_id) AS nxt FROM v_jobs),
m AS (SELECT max(epoch_us(ts) // 1000) AS wm FROM v_jobs)
SELECT job_id, event_id, lease AS expired_at_ms FROM n, m WHERE status = 'RUNNING' AND (lease <= nxt OR (nxt IS NULL AND lease < wm))""", "v_jobs")
def _(t):
    rows = st.read_table_stream(t.spark, t.folder, "events")
    ts = F.col("ts").cast("timestamp")
    log = rows.select(F.col("user_id").alias("job_id"), "event_id", F.when(F.col("event_type") == "view", "RUNNING").otherwise("OTHER").alias("status"),
                      ts.alias("ts"), (ts + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"))
    return st.run_available(st.expired_leases(log))


@query("str6_out_of_range_policy", """
WITH raw AS (SELECT run_id, event_id, start_ms % 600000 - 30000 AS rs, start_ms % 600000 - 30000 + (end_ms - start_ms) // 4 AS re FROM v_spans)
SELECT CASE WHEN least(600000, re) <= greatest(0, rs) THEN 'ASR_TIMESTAMP_DROPPED' WHEN greatest(0, rs) <> rs OR least(600000, re) <> re THEN 'ASR_TIMESTAMP_CLAMPED' ELSE '' END AS warning, count(*) AS n FROM raw GROUP BY 1""", "v_spans")
def _(t):
    start = F.col("start_ms") % 600_000 - 30_000
    raw = span_stream(t).select(
        "run_id", "event_id", F.col("event_type").alias("text"), (F.col("start_ms") - F.col("start_ms") % 600_000).alias("window_start_ms"),
        start.alias("rel_start_ms"), (start + F.floor((F.col("end_ms") - F.col("start_ms")) / 4)).alias("rel_end_ms")
    ).withColumn("window_end_ms", F.col("window_start_ms") + 600_000)
    return st.run_available(project_windows(raw)).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query("str7_incremental_dedup", f"""
WITH RECURSIVE {_TOUCHING},
walk AS (
  SELECT run_id, start_ms, evidence_id, text, confidence, 0 AS slot, true AS took, start_ms + 1000 AS last_end, confidence AS last_conf, text AS last_text FROM tt WHERE start_ms = 0
  UNION ALL
  SELECT c.run_id, c.start_ms, c.evidence_id, c.text, c.confidence, CASE WHEN w.last_end = c.start_ms AND w.last_text = c.text THEN w.slot ELSE w.slot + 1 END,
         NOT (w.last_end = c.start_ms AND w.last_text = c.text) OR c.confidence > w.last_conf,
         CASE WHEN NOT (w.last_end = c.start_ms AND w.last_text = c.text) OR c.confidence > w.last_conf THEN c.start_ms + 1000 ELSE w.last_end END,
         CASE WHEN NOT (w.last_end = c.start_ms AND w.last_text = c.text) OR c.confidence > w.last_conf THEN c.confidence ELSE w.last_conf END,
         CASE WHEN NOT (w.last_end = c.start_ms AND w.last_text = c.text) OR c.confidence > w.last_conf THEN c.text ELSE w.last_text END
  FROM walk w JOIN tt c ON c.run_id = w.run_id AND c.start_ms = w.start_ms + 1000)
SELECT run_id, evidence_id, start_ms, start_ms + 1000 AS end_ms FROM walk WHERE took QUALIFY row_number() OVER (PARTITION BY run_id, slot ORDER BY start_ms DESC) = 1""")
def _(t):
    rows = touching(t).select("run_id", "evidence_id", "text", "confidence", "start_ms", "end_ms")
    # one row of no run, far ahead, closes the stream
    closing = rows.agg(F.max("end_ms").alias("at")).select(
        F.lit(-1).cast("bigint").alias("run_id"), F.lit("").alias("evidence_id"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), (F.col("at") + 3_600_000).alias("start_ms"), (F.col("at") + 3_600_001).alias("end_ms"))
    path = stage_table(rows.unionByName(closing))
    stream = t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)
    return st.settle_slots(st.run_available(st.ordered_dedup(stream))).where("run_id >= 0")
