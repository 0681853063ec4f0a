"""Filter, lookup, aggregation, paging, set and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions import text as tx
from spanledger.functions import timing
from spanledger.operators import history, lookups, selection, spans
from spanledger.operators.scan import Scan, ordered_scan, time_bucket
from spanledger.plans.catalog import query
from spanledger.plans.views import AS_OF

RUN = ["run_id"]
def now():
    return F.to_timestamp(F.lit(AS_OF))

CONTAINED = "w.run_id = e.run_id AND w.start_ms <= e.start_ms AND e.end_ms <= w.end_ms"


def _null_ts():
    return F.lit(None).cast("timestamp")


@query("p1_scope_filter", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey < 1000000""")
def _(t):
    scope = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F") & (F.col("o_custkey") < 1_000_000)
    return t.orders.where(scope).select("o_orderkey", "o_custkey", "o_totalprice")


@query("p2_evidence_filter", "SELECT run_id, evidence_id, start_ms, end_ms FROM v_transcript WHERE role = 'assistant' AND start_ms >= 60000", "v_transcript")
def _(t):
    return t.v_transcript.where("role = 'assistant' AND start_ms >= 60000").select("run_id", "evidence_id", "start_ms", "end_ms")


@query("p3_interval_predicates", """
WITH d AS (SELECT *, start_ms // 86400000 * 86400000 + 3600000 AS lo FROM v_spans)
SELECT run_id, event_id, end_ms - start_ms AS duration_ms, lo <= start_ms AND end_ms <= lo + 43200000 AS inside,
       start_ms < lo + 43200000 AND lo < end_ms AS touches FROM d""", "v_spans")
def _(t):
    low = F.floor(F.col("start_ms") / 86_400_000) * 86_400_000 + 3_600_000
    start, end = F.col("start_ms"), F.col("end_ms")
    return t.v_spans.select(
        "run_id", "event_id", (end - start).alias("duration_ms"),
        timing.contains(low, low + 43_200_000, start, end).alias("inside"),
        timing.overlaps(start, end, low, low + 43_200_000).alias("touches"),
    )


_JOBS = """
j AS (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS attempt_count, 3 AS max_attempts, value > 200 AS cancel_requested, ts + INTERVAL '30' MINUTE AS next_attempt_at,
             CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN NULL ELSE 'worker ' || event_id % 5 END AS worker_id FROM v_jobs)"""


def jobs(t):
    worker = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("worker "), F.col("event_id") % 5))
    return t.v_jobs.select(
        "*", (F.floor("value") % 5).alias("attempt_count"), F.lit(3).alias("max_attempts"),
        (F.col("value") > 200).alias("cancel_requested"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("next_attempt_at"), worker.alias("worker_id"),
    )


_DUE = f"""((status IN ('PENDING', 'RETRY_WAIT') AND next_attempt_at <= TIMESTAMP '{AS_OF}')
   OR (status = 'RUNNING' AND lease_expires_at <= TIMESTAMP '{AS_OF}'))"""


@query("p4_due_work", f"WITH {_JOBS} SELECT job_id, event_id, status FROM j WHERE {_DUE} AND NOT cancel_requested AND attempt_count < max_attempts", "v_jobs")
def _(t):
    return history.claimable(jobs(t), now()).select("job_id", "event_id", "status")


@query("p5_active_owner", f"""
WITH {_JOBS} SELECT job_id, event_id, worker_id FROM j WHERE status = 'RUNNING' AND trim(coalesce(worker_id, '')) <> '' AND lease_expires_at > TIMESTAMP '{AS_OF}'""", "v_jobs")
def _(t):
    return jobs(t).where(history.has_owner(now())).select("job_id", "event_id", "worker_id")


@query("p6_published_runs", """
SELECT o_orderkey AS run_id, o_orderpriority AS artifact FROM orders WHERE o_orderstatus IN ('F', 'P') AND nullif(o_orderpriority, '5-LOW') IS NOT NULL AND o_totalprice IS NOT NULL""")
def _(t):
    success = F.col("o_orderstatus").isin("F", "P")
    pointers = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).isNotNull() & F.col("o_totalprice").isNotNull()
    return t.orders.where(success & pointers).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("artifact"))


@query("p7_oversize_frames", "SELECT run_id, event_id, end_ms - start_ms AS size_bytes FROM v_spans WHERE end_ms - start_ms <= 2000000", "v_spans")
def _(t):
    size = F.col("end_ms") - F.col("start_ms")
    return t.v_spans.where(size <= 2_000_000).select("run_id", "event_id", size.alias("size_bytes"))


_STREAMS = """
s AS (SELECT source AS run_id, doc_id AS stream_index, lang AS language, n_chars % 2 = 0 AS is_default, n_chars % 3 = 0 AS is_forced,
             CASE n_chars % 4 WHEN 0 THEN 'SubRip' WHEN 1 THEN 'webvtt' WHEN 2 THEN 'mov_text' ELSE 'hdmv_pgs_subtitle' END AS codec FROM documents)"""


@query("p8_subtitle_ranking", f"""
WITH {_STREAMS}
SELECT run_id, stream_index, row_number() OVER (PARTITION BY run_id ORDER BY CASE language WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 999 END,
  CASE WHEN is_default THEN 0 ELSE 1 END, CASE WHEN is_forced THEN 1 ELSE 0 END, stream_index) AS rank
FROM s WHERE lower(codec) IN ('subrip', 'ass', 'ssa', 'webvtt', 'mov_text')""")
def _(t):
    from spanledger.sources.captions import rank_subtitle_streams

    codec = F.element_at(F.array(*[F.lit(c) for c in ("SubRip", "webvtt", "mov_text", "hdmv_pgs_subtitle")]), (F.col("n_chars") % 4 + 1).cast("int"))
    streams = t.documents.select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("stream_index"), F.col("lang").alias("language"),
        (F.col("n_chars") % 2 == 0).alias("is_default"), (F.col("n_chars") % 3 == 0).alias("is_forced"), codec.alias("codec"),
    )
    return rank_subtitle_streams(streams, ["es", "en"])


_FIT = """
fit AS (SELECT r.run_id, r.duration_ms, sum(length(e.text)) AS chars, count(*) AS cues, (max(e.end_ms) - min(e.start_ms)) / r.duration_ms AS ratio
        FROM v_transcript e JOIN v_runs r USING (run_id) GROUP BY r.run_id, r.duration_ms)"""


@query("p9_subtitle_sufficiency", f"""
WITH {_FIT} SELECT run_id, CAST(chars AS BIGINT) AS chars, cues, chars >= ceil(greatest(20.0, duration_ms * 24.0 / 60000.0))
  AND cues >= greatest(1, ceil(duration_ms / 30000.0)) AND ratio >= 0.8 AS eligible FROM fit""", "v_transcript v_runs")
def _(t):
    from spanledger.sources.captions import subtitle_sufficiency

    return subtitle_sufficiency(t.v_transcript, t.v_runs, RUN).select("run_id", "chars", "cues", "eligible")


@query("p10_first_eligible_track", """
WITH tr AS (SELECT e.run_id, CASE e.role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS rank, r.duration_ms, sum(length(e.text)) AS chars,
                   count(*) AS cues, (max(e.end_ms) - min(e.start_ms)) / r.duration_ms AS ratio
            FROM v_transcript e JOIN v_runs r ON r.run_id = e.run_id GROUP BY e.run_id, e.role, r.duration_ms),
el AS (SELECT *, chars >= ceil(greatest(20.0, duration_ms * 24.0 / 60000.0)) AND cues >= 1 AND ratio >= 0.4 AS ok FROM tr),
pick AS (SELECT run_id, min(rank) FILTER (WHERE ok) AS chosen FROM el GROUP BY run_id)
SELECT p.run_id, p.chosen, count(*) FILTER (WHERE NOT el.ok AND (p.chosen IS NULL OR el.rank < p.chosen)) AS rejected_before FROM pick p JOIN el USING (run_id) GROUP BY p.run_id, p.chosen""",
       "v_transcript v_runs")
def _(t):
    from spanledger.sources.captions import first_eligible, subtitle_sufficiency

    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    tracks = subtitle_sufficiency(t.v_transcript.withColumn("rank", rank), t.v_runs, ["run_id", "rank"], min_ratio=0.4, cue_ms=None)
    return first_eligible(tracks)


@query("p11_transcript_source", """
SELECT run_id, CASE WHEN bool_or(role = 'system') THEN 'SUBTITLE' WHEN bool_or(role = 'assistant') THEN 'ASR' ELSE 'NONE' END AS source FROM v_transcript GROUP BY run_id""", "v_transcript")
def _(t):
    source = (
        F.when(F.max(F.col("role") == "system"), "SUBTITLE").when(F.max(F.col("role") == "assistant"), "ASR").otherwise("NONE")
    )
    return t.v_transcript.groupBy("run_id").agg(source.alias("source"))


@query("p11_source_warnings", """
WITH r AS (SELECT conv_id, bool_or(role = 'system') AS sub, bool_or(role = 'assistant') AS audio, bool_or(length(text) % 5 = 0) AS trimmed, bool_or(length(text) % 7 = 0) AS told FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN sub THEN 'SUBTITLE' WHEN audio THEN 'ASR' ELSE 'NONE' END AS source,
       concat_ws(',', CASE WHEN trimmed THEN 'TRIMMED' END, CASE WHEN told THEN 'NO_AUDIO_TRACK' END, CASE WHEN sub THEN 'TRANSCRIPT_SOURCE_SUBTITLE' WHEN NOT audio AND NOT told THEN 'NO_AUDIO_TRACK' END) AS warnings FROM r""")
def _(t):
    from spanledger.functions.speech import transcript_source

    flag = lambda c: F.max(c)
    runs = t.conversations.groupBy("conv_id").agg(
        flag(F.col("role") == "system").alias("sub"), flag(F.col("role") == "assistant").alias("audio"), flag(F.length("text") % 5 == 0).alias("trimmed"), flag(F.length("text") % 7 == 0).alias("told"))
    media = F.array_compact(F.array(F.when(F.col("trimmed"), "TRIMMED"), F.when(F.col("told"), "NO_AUDIO_TRACK")))
    source, warnings = transcript_source(F.col("sub"), F.col("audio"), media)
    return runs.select("conv_id", source.alias("source"), F.array_join(warnings, ",").alias("warnings"))


@query("p12_context", r"""
WITH h AS (SELECT page_id, regexp_replace(html, '[\x00-\x1F\x7F]', ' ', 'g') AS h FROM pages), c AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN left(h, 90) || chr(1) WHEN 2 THEN left(h, 600) ELSE h END AS raw FROM h),
n AS (SELECT page_id, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS v FROM c)
SELECT page_id, sha256(v) AS digest, CASE WHEN page_id % 5 = 1 THEN 'CONTROL_CHARACTER' WHEN v = '' THEN 'BLANK' WHEN length(v) > 1000 THEN 'TOO_LONG' ELSE '' END AS reason FROM n""")
def _(t):
    from spanledger.functions.speech import normalize_context

    k, bare = F.col("page_id") % 5, F.regexp_replace("html", r"[\x00-\x1F\x7F]", " ")
    raw = F.when(k == 0, "  ").when(k == 1, F.concat(F.left(bare, F.lit(90)), F.lit("\x01"))).when(k == 2, F.left(bare, F.lit(600))).otherwise(bare)
    value, reason = normalize_context(raw)
    return t.pages.select("page_id", F.sha2(value, 256).alias("digest"), reason.alias("reason"))


@query("p12_hotwords", r"""
WITH h AS (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ', ') AS words FROM conversations),
n AS (SELECT conv_id, turn, len(words) AS n, list_transform(words, lambda w: trim(regexp_replace(w, '\s+', ' ', 'g'))) AS w FROM h)
SELECT conv_id, turn, array_to_string(w, '|') AS hotwords, CASE WHEN n > 50 THEN 'TOO_MANY' WHEN len(list_filter(w, lambda x: x = '')) > 0 THEN 'BLANK'
  WHEN list_max(list_transform(w, lambda x: length(x))) > 64 THEN 'TOO_LONG' WHEN len(list_distinct(w)) <> len(w) THEN 'DUPLICATE'
  WHEN list_sum(list_transform(w, lambda x: strlen(x))) > 2048 THEN 'TOO_MANY_BYTES' ELSE '' END AS reason FROM n""")
def _(t):
    from spanledger.functions.speech import normalize_hotwords

    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), ", ")
    values, reason = normalize_hotwords(words)
    return t.conversations.select("conv_id", "turn", F.array_join(values, "|").alias("hotwords"), reason.alias("reason"))


@query("p13_asr_prompt", """
WITH p AS (SELECT conv_id, turn, role, string_split(text, ', ') AS w FROM conversations)
SELECT conv_id, turn, role || chr(10) || array_to_string(w, ' ') AS prompt, CASE WHEN len(w) = 1 THEN w[1] END AS hint FROM p""")
def _(t):
    from spanledger.functions.speech import asr_prompt, single_hint

    words = F.split("text", ", ")
    return t.conversations.select(
        "conv_id", "turn", asr_prompt(F.col("role"), words).alias("prompt"), single_hint(words).alias("hint"))


# ---- lookups -------------------------------------------------------------------------------------

@query("j1_run_history", """
SELECT o_orderkey, o_orderdate, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC""")
def _(t):
    runs = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    objects = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return runs.join(objects, "o_custkey").select("o_orderkey", "o_orderdate", "c_name", "c_mktsegment").orderBy(
        F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("j2_runs_with_summary", """
SELECT o_orderkey, o_totalprice, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def _(t):
    summaries = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return t.orders.select("o_orderkey", "o_totalprice").join(summaries, "o_orderkey")


def stages(t):
    return jobs(t).select(
        (F.col("job_id") * 40 + F.floor(F.col("event_id") / 500)).alias("run_id"), "event_id", "status", "next_attempt_at", "lease_expires_at",
        F.when(F.col("event_id") % 2 == 0, "LLM").otherwise("TRANSCRIPTION").alias("stage_name"),
    )


_STAGES = _JOBS + ", st AS (SELECT job_id * 40 + event_id // 500 AS run_id, event_id, status, next_attempt_at, lease_expires_at, CASE WHEN event_id % 2 = 0 THEN 'LLM' ELSE 'TRANSCRIPTION' END AS stage_name FROM j)"
_RECOVER = f"""SELECT run_id, event_id, stage_name, status FROM st WHERE {_DUE} AND (stage_name <> 'LLM' OR EXISTS (
  SELECT 1 FROM st s2 WHERE s2.run_id = st.run_id AND s2.stage_name = 'TRANSCRIPTION' AND s2.status = 'SUCCEEDED'))"""


@query("j3_sibling_stage_done", f"WITH {_STAGES} {_RECOVER}", "v_jobs")
def _(t):
    return history.recoverable_stages(stages(t), now()).select("run_id", "event_id", "stage_name", "status")


@query("j4_containment_join", f"""
SELECT e.run_id, e.evidence_id, w.chunk_index FROM v_transcript e JOIN v_windows w ON {CONTAINED}""", "v_transcript v_windows")
def _(t):
    return spans.contained_in(t.v_transcript, t.v_windows, RUN).select("run_id", "evidence_id", F.col("range_chunk_index").alias("chunk_index"))


@query("j5_ordered_assignment", """
SELECT e.run_id, e.evidence_id, w.start_ms AS owner_start, CASE WHEN e.end_ms > w.end_ms THEN 'STRADDLES' ELSE 'OWNED' END AS status
FROM v_transcript e JOIN v_windows w ON w.run_id = e.run_id AND w.start_ms <= e.start_ms AND e.start_ms < w.end_ms""", "v_transcript v_windows")
def _(t):
    return lookups.owner_status(t.v_transcript, t.v_windows, RUN).select("run_id", "evidence_id", "owner_start", "status")


@query("j6_exactly_one_owner", f"""
SELECT e.run_id, e.evidence_id, count(w.run_id) AS owners FROM v_transcript e LEFT JOIN v_windows w ON {CONTAINED}
GROUP BY e.run_id, e.evidence_id HAVING count(w.run_id) <> 1""", "v_transcript v_windows")
def _(t):
    return lookups.not_exactly_one_owner(t.v_transcript, t.v_windows, RUN)


@query("j7_reference_resolution", """
SELECT run_id, string_agg(text, ' | ' ORDER BY seq DESC) AS resolved FROM v_transcript GROUP BY run_id""", "v_transcript")
def _(t):
    refs = t.v_transcript.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("n"), "evidence_id"))), lambda r: r["evidence_id"]).alias("refs"))
    exploded = refs.select("run_id", F.posexplode("refs").alias("pos", "evidence_id"))
    resolved = exploded.join(t.v_transcript.select("run_id", "evidence_id", "text"), ["run_id", "evidence_id"])
    return lookups.ordered_refs(resolved, RUN, "pos", "text").select("run_id", F.array_join("values", " | ").alias("resolved"))


@query("j8_unknown_references", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l.l_partkey)""")
def _(t):
    refs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return lookups.unknown_refs(refs, t.customer, "l_partkey", "c_custkey")


@query("j9_orphan_items", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return lookups.orphans(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 400000"), "c_custkey", "o_custkey")


@query("j10_binding_audit", """
WITH a AS (SELECT doc_id, count(*) AS n FROM documents WHERE quality_ok GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows,
       CASE WHEN a.n IS NULL THEN 'UNEXPECTED' WHEN b.n IS NULL THEN 'MISSING' WHEN a.n > 1 OR b.n > 1 THEN 'DUPLICATE' ELSE 'BOUND' END AS verdict
FROM a FULL JOIN b USING (doc_id)""".replace("WHERE quality_ok", "WHERE lang <> 'de'"))
def _(t):
    return lookups.binding_audit(t.documents.where("lang <> 'de'").select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query("j11_hint_pairs", """
SELECT a.conv_id, a.turn, a.text AS none_text, b.text AS correct_text FROM conversations a JOIN conversations b
ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def _(t):
    talk = t.conversations
    none = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("none_text"))
    correct = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("correct_text"))
    return none.join(correct, ["conv_id", "turn"])


@query("j12_manifest_rebind", """
SELECT doc_id, 'MISSING' AS verdict FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT d.doc_id, 'DIFFERS' FROM documents d JOIN labels l USING (doc_id) WHERE (d.n_chars % 2 = 0) <> (l.quality = 1)""")
def _(t):
    api = t.documents.select("doc_id", (F.col("n_chars") % 2 == 0).alias("flag"))
    manifest = t.labels.select("doc_id", (F.col("quality") == 1).alias("flag"))
    missing = api.join(manifest, "doc_id", "left_anti").select("doc_id", F.lit("MISSING").alias("verdict"))
    shared = api.join(manifest.select("doc_id"), "doc_id", "left_semi")
    differs = shared.exceptAll(manifest).select("doc_id", F.lit("DIFFERS").alias("verdict"))
    return missing.unionByName(differs)


@query("j13_nearest_endpoint", """
WITH q AS (SELECT DISTINCT run_id, start_ms AS ts FROM v_spans), p AS (SELECT DISTINCT run_id, end_ms AS ts FROM v_spans),
c AS (SELECT q.run_id, q.ts, p.ts AS near, abs(p.ts - q.ts) AS d, row_number() OVER (PARTITION BY q.run_id, q.ts ORDER BY abs(p.ts - q.ts), p.ts) AS rk
      FROM q JOIN p ON p.run_id = q.run_id AND abs(p.ts - q.ts) <= 8000000)
SELECT run_id, ts AS timestamp_ms, near AS nearest_ms, d AS distance_ms FROM c WHERE rk = 1""", "v_spans")
def _(t):
    asked = t.v_spans.select("run_id", F.col("start_ms").alias("timestamp_ms"))
    given = t.v_spans.select("run_id", F.col("end_ms").alias("timestamp_ms"))
    return spans.nearest_points(asked, given, RUN, 8_000_000)


@query("j14_uncovered_targets", """
SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_suppkey = l.l_suppkey AND f.l_quantity >= 25)""")
def _(t):
    return lookups.uncovered_targets(t.lineitem, t.lineitem.where("l_quantity >= 25"), ["l_orderkey"], "l_suppkey")


@query("j15_frames_by_digest", """
SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS target_ids FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("first_line"),
        F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("target_ids"))


@query("j16_anchor_spans", f"""
SELECT w.run_id, w.chunk_index, min(e.start_ms) AS anchor_start_ms, max(e.end_ms) AS anchor_end_ms FROM v_windows w JOIN v_transcript e ON {CONTAINED} GROUP BY 1, 2""",
       "v_windows v_transcript")
def _(t):
    inside = spans.contained_in(t.v_transcript, t.v_windows, RUN)
    return inside.groupBy("run_id", F.col("range_chunk_index").alias("chunk_index")).agg(
        F.min("start_ms").alias("anchor_start_ms"), F.max("end_ms").alias("anchor_end_ms"))


@query("j17_idempotent_requests", """
WITH s AS (SELECT o_custkey AS k, min(o_orderpriority) AS config FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, CASE WHEN s.k IS NULL THEN 'NEW' WHEN s.config = o_orderpriority THEN 'REUSED' ELSE 'CONFLICT' END AS outcome
FROM orders LEFT JOIN s ON s.k = o_custkey WHERE o_orderstatus <> 'F'""")
def _(t):
    stored = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("config"))
    asked = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("config"))
    return lookups.idempotent_requests(asked, stored, "o_custkey", "config").select("o_orderkey", "outcome")


@query("j18_orphan_artifacts", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)
  AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def _(t):
    lines = t.lineitem
    pointers = lines.where("l_returnflag = 'R' AND l_discount > 0.09").select("l_partkey").unionByName(lines.where("l_quantity > 49").select("l_partkey"))
    return lookups.orphans(t.part.select("p_partkey", "p_name"), pointers, "p_partkey", "l_partkey")


# ---- paging, top-k and packing ---------------------------------------------------------------------

@query("l1_document_order", """
WITH k AS (SELECT run_id, evidence_id, start_ms, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS kind FROM v_transcript)
SELECT run_id, evidence_id, row_number() OVER (PARTITION BY run_id ORDER BY kind, start_ms, evidence_id) - 1 AS position FROM k""", "v_transcript")
def _(t):
    kind = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = t.v_transcript.select("run_id", "evidence_id", "start_ms", kind.alias("kind"))
    bucket = F.struct("kind", time_bucket("start_ms", spans.SLICE_MS).alias("slice"))
    return ordered_scan(rows, RUN, ["kind", "start_ms", "evidence_id"], bucket, [Scan("position", "count_before")]).select(
        "run_id", "evidence_id", "position")


@query("l2_evidence_page", """
WITH r AS (SELECT run_id, evidence_id, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY run_id) AS n FROM v_sentences
           WINDOW w AS (PARTITION BY run_id ORDER BY start_ms, end_ms, evidence_id))
SELECT run_id, evidence_id, position, n > 75 AS has_more FROM r WHERE position >= 50 AND position < 75""", "v_sentences")
def _(t):
    rows = t.v_sentences.select("run_id", "evidence_id", "start_ms", "end_ms")
    out = selection.page(rows, RUN, ["start_ms", "end_ms", "evidence_id"], time_bucket("start_ms", 600_000), 50, 25)
    return out.select("run_id", "evidence_id", "position", "has_more")


@query("l3_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1234 ORDER BY o_orderkey LIMIT 100")
def _(t):
    return selection.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1234, 100)


@query("l4_next_claimable", f"""
WITH {_JOBS} SELECT worker_id, event_id, next_attempt_at FROM j WHERE {_DUE} AND NOT cancel_requested AND attempt_count < max_attempts
QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY next_attempt_at, event_id) = 1""", "v_jobs")
def _(t):
    due = history.claimable(jobs(t), now())
    first = due.groupBy("worker_id").agg(F.min(F.struct("next_attempt_at", "event_id")).alias("f"))
    return first.select("worker_id", "f.event_id", "f.next_attempt_at")


@query("l5_top_frames", """
SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 6""")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    top = selection.first_per_group(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 6)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


def order_frames(t):
    """Frames per order: one per distinct supplier, at most seven lines an order."""
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").cast("bigint").alias("ord"), F.sum(F.col("l_quantity").cast("bigint") * 1000).alias("size_bytes"),
        F.array_distinct(F.array(F.min("l_partkey") % 3, F.max("l_partkey") % 3)).alias("target_ids"),
    ).withColumn("frame_id", F.col("l_suppkey"))


@query("l6_coverage_trim", """
WITH RECURSIVE fr AS (
  SELECT l_orderkey, l_suppkey AS frame_id, min(l_linenumber) AS ord, sum(CAST(l_quantity AS BIGINT) * 1000) AS size, list_distinct([min(l_partkey) % 3, max(l_partkey) % 3]) AS t FROM lineitem GROUP BY ALL),
fl AS (SELECT l_orderkey, list({'ord': ord, 'id': frame_id, 'size': size, 't': t} ORDER BY ord, frame_id) AS f FROM fr WHERE size <= 48000 GROUP BY l_orderkey),
tg AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [0] WHEN o_orderkey % 3 = 1 THEN [0, 1] ELSE [2] END AS req FROM orders),
walk AS (
  SELECT l_orderkey, req, f, f AS kept, len(f) AS i FROM tg JOIN fl USING (l_orderkey)
  UNION ALL
  SELECT l_orderkey, req, f, CASE WHEN (len(kept) > 2 OR list_sum(list_transform(kept, lambda x: x.size)) > 90000)
      AND len(list_filter(req, lambda r: NOT list_contains(flatten(list_transform(list_filter(kept, lambda x: x.ord <> f[i].ord), lambda x: x.t)), r))) = 0
    THEN list_filter(kept, lambda x: x.ord <> f[i].ord) ELSE kept END, i - 1 FROM walk WHERE i > 0),
done AS (SELECT * FROM walk WHERE i = 0)
SELECT tg.l_orderkey, array_to_string(list_transform(kept, lambda x: x.id), ',') AS frame_ids, CASE WHEN kept IS NULL THEN 'NO_ADMITTED_FRAME'
  WHEN len(list_filter(done.req, lambda r: NOT list_contains(flatten(list_transform(kept, lambda x: x.t)), r))) > 0 THEN 'TARGET_NOT_COVERED'
  WHEN len(kept) > 3 OR list_sum(list_transform(kept, lambda x: x.size)) > 90000 THEN 'NO_REMOVABLE_FRAME' ELSE '' END AS reason
FROM tg LEFT JOIN done USING (l_orderkey)""")
def _(t):
    targets = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(0))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))).cast("array<bigint>")
    ).alias("target_id"))
    out = selection.trim_frames(order_frames(t), targets, ["l_orderkey"], 2, 90_000, 48_000, escalate=True)
    return out.withColumn("frame_ids", F.array_join(F.transform("frame_ids", lambda x: x.cast("string")), ","))


@query("l7_value_eviction", """
WITH o AS (SELECT l_suppkey AS run_id, l_orderkey * 8 + l_linenumber AS observation_id, l_partkey % 20 AS sha256, CAST(l_quantity AS BIGINT) AS certainty FROM lineitem),
ob AS (SELECT run_id, observation_id, min(certainty) AS certainty, list(DISTINCT sha256) AS shas FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY certainty, observation_id) AS value_rank FROM ob),
f AS (SELECT run_id, unnest(shas) AS sha256, value_rank FROM r),
m AS (SELECT run_id, sha256, max(value_rank) AS top, 1000 + sha256 * 10 AS size FROM f GROUP BY 1, 2),
c AS (SELECT run_id, top, sum(n) OVER w AS files, sum(b) OVER w AS bytes FROM (SELECT run_id, top, count(*) AS n, sum(size) AS b FROM m GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY run_id ORDER BY top DESC)),
k AS (SELECT run_id, max(top) AS cut FROM c WHERE files > 12 OR bytes > 13000 GROUP BY 1)
SELECT run_id, observation_id, value_rank, value_rank > coalesce(cut, 0) AS retained FROM r LEFT JOIN k USING (run_id)""")
def _(t):
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("observation_id"),
        (F.col("l_partkey") % 20).alias("sha256"), F.col("l_quantity").cast("bigint").alias("certainty"))
    observations = lines.groupBy("run_id", "observation_id").agg(F.min("certainty").alias("certainty"))
    frames = lines.select("run_id", "observation_id", "sha256", (1000 + F.col("sha256") * 10).alias("size_bytes")).distinct()
    bucket = F.struct("certainty", F.floor(F.col("observation_id") / 16_384).alias("part"))
    out = selection.evict_to_budget(observations, frames, RUN, ["certainty", "observation_id"], bucket, 12, 13_000)
    return out.select("run_id", "observation_id", "value_rank", "retained")


@query("l8_first_fit", """
WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber || '_' || l_partkey AS id, list_distinct([l_suppkey % 5, l_partkey % 5]) AS fr,
                            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber || '_' || l_partkey, l_suppkey % 5) AS rn FROM lineitem),
w AS (SELECT l_orderkey, rn, fr AS frames, id AS ids FROM o WHERE rn = 1
      UNION ALL
      SELECT o.l_orderkey, o.rn, CASE WHEN len(list_distinct(list_concat(w.frames, o.fr))) <= 3 THEN list_distinct(list_concat(w.frames, o.fr)) ELSE w.frames END,
             CASE WHEN len(list_distinct(list_concat(w.frames, o.fr))) <= 3 THEN w.ids || ',' || o.id ELSE w.ids END
      FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.rn = w.rn + 1)
SELECT l_orderkey, ids AS observation_ids, array_to_string(list_sort(frames), ',') AS frame_ids FROM w QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rn DESC) = 1""")
def _(t):
    obs = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("ord"), F.concat_ws("_", "l_linenumber", "l_partkey").alias("observation_id"),
        F.array_distinct(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5)).alias("frame_ids"))
    out = selection.first_fit(obs, ["l_orderkey"], 3)
    return out.select("l_orderkey", F.array_join("observation_ids", ",").alias("observation_ids"),
                      F.array_join(F.transform("frame_ids", lambda x: x.cast("string")), ",").alias("frame_ids"))


@query("l9_request_batches", """
WITH RECURSIVE s AS (SELECT run_id, seq, length(text) AS c, strlen(text) AS b, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM v_sentences),
w AS (SELECT run_id, rn, seq, seq AS batch_start, CAST(1 AS BIGINT) AS n, CAST(c AS BIGINT) AS cs, CAST(b AS BIGINT) AS bs FROM s WHERE rn = 1
      UNION ALL
      SELECT s.run_id, s.rn, s.seq, CASE WHEN w.n >= 24 OR w.cs + s.c > 1500 OR w.bs + s.b > 1600 THEN s.seq ELSE w.batch_start END,
             CASE WHEN w.n >= 24 OR w.cs + s.c > 1500 OR w.bs + s.b > 1600 THEN 1 ELSE w.n + 1 END,
             CASE WHEN w.n >= 24 OR w.cs + s.c > 1500 OR w.bs + s.b > 1600 THEN s.c ELSE w.cs + s.c END,
             CASE WHEN w.n >= 24 OR w.cs + s.c > 1500 OR w.bs + s.b > 1600 THEN s.b ELSE w.bs + s.b END
      FROM w JOIN s ON s.run_id = w.run_id AND s.rn = w.rn + 1)
SELECT run_id, seq, batch_start FROM w""", "v_sentences")
def _(t):
    rows = t.v_sentences.select("run_id", "seq", "text")
    return selection.pack_batches(rows, RUN, "seq", 24, 1500, 1600).select("run_id", "seq", "batch_start")


@query("l10_fit_prefix", """
SELECT run_id, seq FROM (SELECT run_id, seq, length(text) AS n, sum(length(text)) OVER (PARTITION BY run_id ORDER BY seq) AS total, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM v_sentences)
WHERE total <= 2000 OR rn = 1""", "v_sentences")
def _(t):
    rows = t.v_sentences.select("run_id", "seq", "text")
    return selection.fit_prefix(rows, RUN, ["seq"], F.floor(F.col("seq") / 256), 2000).select("run_id", "seq")


@query("l11_uniform_scale", """
WITH RECURSIVE l AS (SELECT run_id, list(length(text)) AS lens FROM v_transcript GROUP BY run_id),
b AS (SELECT run_id, lens, CAST(0 AS BIGINT) AS lo, CAST(1000000 AS BIGINT) AS hi, CAST(0 AS BIGINT) AS best, 0 AS it FROM l
      UNION ALL
      SELECT run_id, lens, CASE WHEN lo <= hi AND ok THEN mid + 1 ELSE lo END, CASE WHEN lo <= hi AND NOT ok THEN mid - 1 ELSE hi END,
             CASE WHEN lo <= hi AND ok THEN mid ELSE best END, it + 1
      FROM (SELECT *, (lo + hi) // 2 AS mid, list_sum(list_transform(lens, lambda n: least(n, greatest(1, n * ((lo + hi) // 2) // 1000000)))) <= 600 AS ok FROM b) WHERE it < 21)
SELECT run_id, best AS scale, CAST(list_sum(list_transform(lens, lambda n: least(n, greatest(1, n * best // 1000000)))) AS BIGINT) AS total_chars,
       list_sum(list_transform(lens, lambda n: least(n, greatest(1, n * best // 1000000)))) <= 600 AS fits FROM b WHERE it = 21""", "v_transcript")
def _(t):
    return selection.uniform_scale(t.v_transcript.select("run_id", "text"), RUN, 600)


@query("l12_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("l13_boundary_cap", """
SELECT run_id, seq, text FROM (SELECT run_id, seq, substring(text, 1, 240) AS text, row_number() OVER w AS rn,
  sum(strlen(substring(text, 1, 240))) OVER w AS b FROM v_sentences WINDOW w AS (PARTITION BY run_id ORDER BY seq)) WHERE rn <= 63 AND b <= 4096""", "v_sentences")
def _(t):
    rows = t.v_sentences.select("run_id", "seq", "text")
    return selection.capped_boundaries(rows, RUN, ["seq"], F.floor(F.col("seq") / 256), 63, 4096, 240)


# ---- set operations -------------------------------------------------------------------------------

@query("s1_union_evidence", """
WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS evidence_id, 'TURN' AS kind FROM conversations UNION ALL SELECT CAST(doc_id AS VARCHAR), 'DOCUMENT' FROM documents)
SELECT evidence_id, count(*) AS copies, min(kind) AS kind, count(*) > 1 AS duplicate FROM u GROUP BY evidence_id""")
def _(t):
    turns = t.conversations.select(F.col("conv_id").cast("string").alias("evidence_id"), F.lit("TURN").alias("kind"))
    docs = t.documents.select(F.col("doc_id").cast("string").alias("evidence_id"), F.lit("DOCUMENT").alias("kind"))
    return turns.unionByName(docs).groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("kind").alias("kind"), (F.count(F.lit(1)) > 1).alias("duplicate"))


@query("s2_distinct_union", "SELECT run_id, start_ms AS timestamp_ms FROM v_transcript UNION SELECT run_id, end_ms FROM v_transcript", "v_transcript")
def _(t):
    rows = t.v_transcript
    return rows.select("run_id", F.col("start_ms").alias("timestamp_ms")).unionByName(
        rows.select("run_id", F.col("end_ms").alias("timestamp_ms"))).distinct()


@query("s3_set_difference", """
(SELECT doc_id, 'EXTRA' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))
UNION ALL (SELECT doc_id, 'MISSING' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'))""")
def _(t):
    docs, labels = t.documents, t.labels.select("doc_id")
    extra = docs.select("doc_id").subtract(labels).withColumn("side", F.lit("EXTRA"))
    missing = labels.subtract(docs.where("lang = 'en'").select("doc_id")).withColumn("side", F.lit("MISSING"))
    return extra.unionByName(missing)


@query("s4_intersections", """
SELECT sample_id, count(*) AS predicted, CAST(sum(supported) AS BIGINT) AS supported, CAST(sum(CASE WHEN is_key = 1 THEN supported ELSE 0 END) AS BIGINT) AS key_supported FROM v_facts GROUP BY sample_id""", "v_facts")
def _(t):
    return t.v_facts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("predicted"), F.sum("supported").alias("supported"),
        F.sum(F.col("supported") * F.col("is_key")).alias("key_supported"))


@query("s5_subset_test", """
SELECT sample_id, bool_and(is_key = 0 OR supported = 1) AS keys_supported FROM v_facts GROUP BY sample_id""", "v_facts")
def _(t):
    return t.v_facts.groupBy("sample_id").agg(F.min((F.col("is_key") == 0) | (F.col("supported") == 1)).alias("keys_supported"))


# ---- job and run history ----------------------------------------------------------------------------

@query("h1_job_state", f"""
WITH {_JOBS},
a AS (SELECT job_id, max((ts, event_id, status, lease_expires_at)) AS l, CAST(sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS attempts,
             bool_or(cancel_requested) AS c, count(*) AS entries FROM j GROUP BY job_id)
SELECT job_id, attempts, entries, CASE WHEN c AND l[3] <> 'SUCCEEDED' THEN 'CANCELLED' WHEN l[3] = 'FAILED' AND attempts < 12 THEN 'RETRY_WAIT' ELSE l[3] END AS state,
       CASE WHEN l[3] = 'RUNNING' THEN l[4] END AS lease_expires_at FROM a""", "v_jobs")
def _(t):
    return history.job_state(jobs(t), 12)


@query("h2_recoverable_work", f"WITH {_STAGES}, r AS ({_RECOVER}) SELECT stage_name, status, count(*) AS n FROM r GROUP BY ALL", "v_jobs")
def _(t):
    return history.recoverable_stages(stages(t), now()).groupBy("stage_name", "status").agg(F.count(F.lit(1)).alias("n"))


@query("h3_stage_durations", """
SELECT run_id, event_type AS stage, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms, count(*) AS n, count(*) FILTER (WHERE confidence < 0.1) AS cache_hits FROM v_spans GROUP BY ALL""", "v_spans")
def _(t):
    return t.v_spans.groupBy("run_id", F.col("event_type").alias("stage")).agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("confidence") < 0.1, 1).otherwise(0)).alias("cache_hits"))


@query("h4_run_rollup", """
WITH w AS (SELECT run_id, event_type, min(event_id) AS p FROM v_spans GROUP BY ALL),
l AS (SELECT run_id, string_agg(event_type, ',' ORDER BY p) AS warnings FROM w GROUP BY run_id)
SELECT s.run_id, any_value(l.warnings) AS warnings, CASE WHEN bool_or(event_type = 'error') THEN 'PARTIAL_SUCCEEDED' ELSE 'SUCCEEDED' END AS status,
       CAST(sum(end_ms - start_ms) AS BIGINT) AS busy_ms FROM v_spans s JOIN l USING (run_id) GROUP BY s.run_id""", "v_spans")
def _(t):
    rows = t.v_spans
    warnings = history.ordered_warnings(rows, RUN, "event_id", "event_type")
    partial = F.when(F.max(F.col("event_type") == "error"), "PARTIAL_SUCCEEDED").otherwise("SUCCEEDED")
    totals = rows.groupBy("run_id").agg(partial.alias("status"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("busy_ms"))
    return totals.join(warnings, "run_id").withColumn("warnings", F.array_join("warnings", ","))


# ---- aggregations ---------------------------------------------------------------------------------

@query("a3_nearest_rank_p90", """
SELECT o_orderpriority, n, quantile_value FROM (SELECT o_orderpriority, o_totalprice AS quantile_value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE rn = greatest(1, CAST(ceil(n * 0.9::DECIMAL(10,6)) AS BIGINT))""")
def _(t):
    rows = t.orders.select("o_orderpriority", "o_totalprice")
    return selection.nearest_rank(rows, ["o_orderpriority"], "o_totalprice", 0.9, F.floor(F.col("o_totalprice") / 1000))


@query("a4_valid_result_rate", "SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS valid_rate, count(*) AS attempted FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 9).alias("valid_rate"), F.count(F.lit(1)).alias("attempted"))


@query("a5_runtime_resources", """
SELECT run_id, round(max((end_ms - start_ms) / 1000.0 / ((event_id % 900 + 100) / 1000.0)), 9) AS rtf, max(event_id * 3) AS peak_rss_bytes, max(start_ms) AS peak_disk_bytes FROM v_spans GROUP BY run_id""", "v_spans")
def _(t):
    rtf = ((F.col("end_ms") - F.col("start_ms")) / 1000.0) / ((F.col("event_id") % 900 + 100) / 1000.0)
    return t.v_spans.groupBy("run_id").agg(
        F.round(F.max(rtf), 9).alias("rtf"), F.max(F.col("event_id") * 3).alias("peak_rss_bytes"), F.max("start_ms").alias("peak_disk_bytes"))


@query("a6_judgment_rates", """
SELECT lang, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 9) AS fact_support_rate, round(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) / count(*), 9) AS key_fact_recall,
       count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fabricated_name_count FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def _(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    n = F.count(F.lit(1))
    return rows.groupBy("lang").agg(
        F.round(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)) / n, 9).alias("fact_support_rate"),
        F.round(F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)) / n, 9).alias("key_fact_recall"),
        F.sum(F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 1).otherwise(0)).alias("fabricated_name_count"))


@query("a7_claim_closure_rate", """
WITH r AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 12),
c AS (SELECT o_orderkey, count(l_orderkey) > 0 AND count(*) = count(c_custkey) AS closed FROM orders LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = l_partkey GROUP BY o_orderkey)
SELECT count(*) AS claims, count(*) FILTER (WHERE closed) AS closed, round(count(*) FILTER (WHERE closed) / count(*), 9) AS rate FROM c""")
def _(t):
    from spanledger.operators.quality import closure_rate

    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"))
    refs = t.lineitem.where("l_quantity > 12").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("ref"))
    return closure_rate(claims, refs, t.customer.select(F.col("c_custkey").alias("ref")))


@query("a8_rubric_means", """
WITH r AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'RELEVANT' WHEN quality = 1 THEN 'PARTIAL' ELSE 'IRRELEVANT' END AS title, CASE WHEN toxic = 1 THEN 'DUPLICATES' ELSE 'SUPPLEMENTS' END AS verdict FROM labels JOIN documents USING (doc_id))
SELECT lang, round(avg(CASE title WHEN 'RELEVANT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END), 9) AS title_relevance,
       round(avg(CASE WHEN verdict = 'SUPPLEMENTS' THEN 1.0 ELSE 0.0 END), 9) AS visual_supplement_rate, round(avg(CASE WHEN verdict = 'DUPLICATES' THEN 1.0 ELSE 0.0 END), 9) AS visual_duplicate_rate FROM r GROUP BY lang""")
def _(t):
    from spanledger.operators.quality import rubric_means

    title = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "RELEVANT").when(F.col("quality") == 1, "PARTIAL").otherwise("IRRELEVANT")
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        "lang", title.alias("title_relevance"), F.when(F.col("toxic") == 1, "DUPLICATES").otherwise("SUPPLEMENTS").alias("verdict"))
    return rubric_means(rows, ["lang"])


@query("a9_visual_accuracy", """
WITH c AS (SELECT sample_id % 5 AS grp, CASE WHEN sample_id % 5 = 0 THEN 0 ELSE count(*) END AS units, sum(1 - supported) AS errors, CASE WHEN sample_id % 5 = 3 THEN 0 ELSE sum(is_key) END AS fields,
       sum(is_key * supported) AS hits, sample_id % 5 <> 1 OR sample_id % 7 <> 0 AS ok FROM v_facts GROUP BY sample_id),
g AS (SELECT grp, bool_and(ok) AS ok, sum(units) AS units, sum(errors) AS errors, sum(fields) AS fields, sum(hits) AS hits FROM c GROUP BY grp)
SELECT grp, CASE WHEN ok AND units > 0 THEN round(greatest(0.0, 1.0 - errors / units), 9) END AS visual_text_accuracy, CASE WHEN ok AND fields > 0 THEN round(hits / fields, 9) END AS visual_key_field_recall,
       CASE WHEN NOT ok THEN 'CASES_NOT_READY' WHEN units = 0 THEN 'NO_REFERENCE_TEXT' ELSE '' END AS text_reason, CASE WHEN NOT ok THEN 'CASES_NOT_READY' WHEN fields = 0 THEN 'NO_KEY_FIELDS' ELSE '' END AS key_reason FROM g""", "v_facts")
def _(t):
    from spanledger.operators.quality import visual_accuracy

    group = F.col("sample_id") % 5
    cases = t.v_facts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("units"), F.sum(1 - F.col("supported")).alias("errors"), F.sum("is_key").alias("fields"), F.sum(F.col("is_key") * F.col("supported")).alias("hits"))
    cases = cases.select(
        group.alias("grp"), F.when(group == 0, 0).otherwise(F.col("units")).alias("units"), "errors", F.when(group == 3, 0).otherwise(F.col("fields")).alias("fields"), "hits",
        ((group != 1) | (F.col("sample_id") % 7 != 0)).alias("succeeded"))
    return visual_accuracy(cases, ["grp"])


@query("a10_language_coverage", """
WITH need AS (SELECT unnest(['zh', 'en', 'ja', 'ko', 'es']) AS lang), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT need.lang, coalesce(n, 0) AS samples, coalesce(n, 0) >= 6 AS enough FROM need LEFT JOIN c USING (lang)""")
def _(t):
    from spanledger.operators.quality import language_coverage

    return language_coverage(t.documents.select("lang"))


@query("a11_representativeness", """
SELECT count(DISTINCT user_id) >= 3 AND count(*) >= 12 AND least(count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'error')) >= 3 AS representative,
       count(DISTINCT user_id) AS media, count(*) AS frames FROM events""")
def _(t):
    from spanledger.operators.quality import representativeness

    return representativeness(t.events.select(F.col("user_id").alias("media"), F.col("event_type").alias("category")), ["view", "click", "error"])


@query("a12_exclusion_reasons", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(hypothesis) < 60 THEN 'PREDICTION_NOT_SUCCESSFUL' WHEN lang = 'de' THEN 'TRANSCRIPT_SOURCE_NOT_ASR'
  WHEN length(reference) < 60 THEN 'TERMS_EMPTY' ELSE '' END AS reason FROM v_pairs) WHERE reason <> '' GROUP BY reason""", "v_pairs")
def _(t):
    reason = (
        F.when(F.length("hypothesis") < 60, "PREDICTION_NOT_SUCCESSFUL").when(F.col("lang") == "de", "TRANSCRIPT_SOURCE_NOT_ASR")
        .when(F.length("reference") < 60, "TERMS_EMPTY").otherwise(""))
    return t.v_pairs.select(reason.alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a13_metric_rollup", """
WITH names AS (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS name), r AS (SELECT DISTINCT user_id AS run_id FROM events)
SELECT r.run_id, names.name, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS value FROM r CROSS JOIN names LEFT JOIN events e ON e.user_id = r.run_id AND e.event_type = names.name GROUP BY ALL""")
def _(t):
    metrics = t.events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.floor("value").alias("value"))
    return history.metric_rollup(metrics, ["view", "click", "purchase", "refund"], RUN)


@query("a14_status_rollup", """
SELECT job_id * 40 + event_id // 500 AS run_id, CASE WHEN bool_or(status = 'FAILED') THEN 'FAIL' WHEN bool_or(status = 'PENDING') THEN 'NOT_RUN' ELSE 'PASS' END AS status FROM v_jobs GROUP BY ALL""", "v_jobs")
def _(t):
    status = F.when(F.col("status") == "FAILED", "FAIL").when(F.col("status") == "PENDING", "NOT_RUN").otherwise("PASS")
    run = F.col("job_id") * 40 + F.floor(F.col("event_id") / 500)
    rows = t.v_jobs.select(run.alias("run_id"), status.alias("verdict"))
    return rows.groupBy("run_id").agg(history.worst_status("verdict").alias("status"))


@query("a14_audio_status", """
WITH w AS (SELECT user_id AS run_id, event_id // 700 AS part, event_type, min(event_id) AS p FROM events WHERE event_type IN ('error', 'signup') AND event_id % 3 = 0 GROUP BY ALL), r AS (SELECT DISTINCT user_id AS run_id, event_id // 700 AS part FROM events),
l AS (SELECT run_id, part, string_agg(event_type, ',' ORDER BY p) AS warnings FROM w GROUP BY ALL)
SELECT run_id, part, coalesce(warnings, '') AS warnings, CASE WHEN warnings IS NULL THEN 'SUCCEEDED' ELSE 'PARTIAL_SUCCEEDED' END AS status FROM r LEFT JOIN l USING (run_id, part)""")
def _(t):
    rows = t.events.select(F.col("user_id").alias("run_id"), F.expr("event_id div 700").alias("part"), "event_id", "event_type")
    out = history.audio_status(rows.where("event_type IN ('error', 'signup') AND event_id % 3 = 0"), rows, ["run_id", "part"], "event_id", "event_type")
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("a15_first_seen_warnings", """
SELECT run_id, string_agg(event_type, ',' ORDER BY p) AS warnings FROM (SELECT run_id, event_type, min(event_id) AS p FROM v_spans GROUP BY ALL) GROUP BY run_id""", "v_spans")
def _(t):
    return history.ordered_warnings(t.v_spans, RUN, "event_id", "event_type").withColumn("warnings", F.array_join("warnings", ","))


@query("a16_unique_frames", """
SELECT l_partkey AS frame_id, first_order, first_line FROM (SELECT l_partkey, l_orderkey AS first_order, l_linenumber AS first_line,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    first = t.lineitem.groupBy(F.col("l_partkey").alias("frame_id")).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return first.select("frame_id", F.col("f.l_orderkey").alias("first_order"), F.col("f.l_linenumber").alias("first_line"))


@query("a17_size_budgets", """
SELECT source, count(*) AS items, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) <= 45 AND sum(strlen(text)) <= 120000 AS within_budget FROM documents GROUP BY source""")
def _(t):
    size = F.octet_length("text").cast("bigint")
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("bytes")).withColumn(
        "within_budget", (F.col("items") <= 45) & (F.col("bytes") <= 120_000))


@query("a18_capacity_profile", """
WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + 1 AS duration_ms FROM orders),
p AS (SELECT o_orderkey, least((duration_ms + 999) // 1000 * 500000, 60000000) AS proxy, (duration_ms * 24000 + 999) // 1000 + 65536 AS audio, 14400000 + 65536 AS slice FROM m)
SELECT o_orderkey, proxy AS proxy_bytes, audio AS audio_bytes, CAST(2 * proxy + audio + slice + 111111 AS BIGINT) AS required_bytes, 2 * proxy + audio + slice + 111111 <= 100000000 AS fits FROM p""")
def _(t):
    from spanledger.sources.media import capacity_profile

    media = t.orders.select("o_orderkey", (F.floor("o_totalprice") + 1).alias("duration_ms"))
    return capacity_profile(media, 500_000, 60_000_000, 600_000, 111_111, 100_000_000)


@query("a19_fallback_chapters", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS fallback FROM lineitem)
SELECT l_orderkey AS chapter_id, bool_or(fallback) AS is_fallback, count(*) FILTER (WHERE fallback) AS fallback_segments FROM f GROUP BY l_orderkey""")
def _(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("chapter_id"), "l_linenumber", (F.col("l_returnflag") == "R").alias("fallback"))
    return refs.groupBy("chapter_id").agg(
        F.max("fallback").alias("is_fallback"), F.sum(F.when(F.col("fallback"), 1).otherwise(0)).alias("fallback_segments"))
