"""Validation rule queries (violation rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions.text import normalize_text
from spanledger.operators import closure, lookups
from spanledger.plans.catalog import query
from spanledger.plans.views import sql_norm

RUN = ["run_id"]


def _row(rule, run, entity, ref="''", detail="''"):
    text = lambda x: f"coalesce(CAST({x} AS VARCHAR), '')"
    return f"CAST({run} AS VARCHAR) AS run_id, '{rule}' AS rule, {text(entity)} AS entity_id, {text(ref)} AS ref_id, {text(detail)} AS detail"


@query("v1_duplicate_ids", f"SELECT {_row('DUPLICATE_ID', 'l_orderkey', 'l_linenumber', detail='count(*)')} FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(t):
    return closure.duplicate_ids(t.lineitem, "l_orderkey", "l_linenumber")


@query("v2_unknown_references", f"SELECT {_row('UNKNOWN_REFERENCE', 'l_orderkey', 'l_linenumber', 'l_partkey')} FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = l.l_partkey)")
def _(t):
    return closure.unknown_references(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.customer.select("c_custkey"), "l_orderkey", "l_linenumber", "l_partkey")


@query("v3_outside_chapter", f"""
SELECT {_row('OUTSIDE_CHAPTER', 'e.run_id', 'e.evidence_id', 'w.start_ms')} FROM v_transcript e JOIN v_windows w ON w.run_id = e.run_id AND w.start_ms <= e.start_ms AND e.start_ms < w.end_ms WHERE e.end_ms > w.end_ms""", "v_transcript v_windows")
def _(t):
    owned = lookups.owner_status(t.v_transcript, t.v_windows, RUN).where("status <> 'OWNED'")
    return closure.violation(owned, "OUTSIDE_CHAPTER", F.col("run_id"), F.col("evidence_id"), F.col("owner_start"))


@query("v4_type_mismatch", f"SELECT {_row('TYPE_MISMATCH', 'l_orderkey', 'l_linenumber', 'l_partkey', 'p_type')} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'ECONOMY'")
def _(t):
    typed = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("evidence_type"))
    return closure.type_mismatches(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), typed, "l_orderkey", "l_linenumber", "l_partkey", "ECONOMY")


@query("v5_relation_policy", f"""
WITH u AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'DUPLICATE' WHEN 'click' THEN 'CONFLICTING' ELSE 'SUPPORTING' END AS relation, event_id % 2 = 0 AS visual, props, CASE WHEN event_id % 3 = 0 THEN props ELSE 'x' END AS seen FROM events)
SELECT {_row('RELATION_POLICY', 'user_id', 'event_id', detail='relation')} FROM u WHERE relation = 'DUPLICATE' OR (relation = 'CONFLICTING' AND NOT (visual AND props = seen))""")
def _(t):
    relation = F.when(F.col("event_type") == "view", "DUPLICATE").when(F.col("event_type") == "click", "CONFLICTING").otherwise("SUPPORTING")
    uses = t.events.select(
        "user_id", "event_id", relation.alias("relation"), F.when(F.col("event_id") % 2 == 0, "VISUAL").otherwise("PARAGRAPH").alias("block_type"),
        F.col("props").alias("caption"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("x").alias("observed_caption"))
    return closure.relation_policy(uses, "user_id", "event_id")


@query("v6_attribution_closure", f"""
WITH c AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS refs, list(DISTINCT l_suppkey) FILTER (WHERE l_quantity >= 45) AS title, list(DISTINCT l_partkey % 100) FILTER (WHERE l_quantity >= 49) AS body,
                  bool_or(l_returnflag = 'A') AS grounded FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey, refs, coalesce(title, []) AS title, coalesce(body, []) AS body, grounded FROM c),
v AS (SELECT *, CASE WHEN len(list_distinct(refs)) <> len(refs) THEN 'DUPLICATE_REFERENCE' WHEN len(list_filter(list_concat(title, body), lambda x: NOT list_contains(refs, x))) > 0 THEN 'REFERENCE_OUTSIDE_CHAPTER'
   WHEN grounded AND len(title) = 0 THEN 'HEADER_WITHOUT_REFERENCE' WHEN NOT grounded THEN 'EMPTY_CHAPTER_WITH_REFERENCES' END AS r FROM n)
SELECT {_row('ATTRIBUTION', 'l_orderkey', 'l_orderkey', detail='r')} FROM v WHERE r IS NOT NULL""")
def _(t):
    pick = lambda c, value: F.array_distinct(F.collect_list(F.when(c, value)))
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list("l_suppkey").alias("evidence_refs"), pick(F.col("l_quantity") >= 45, F.col("l_suppkey")).alias("title_refs"),
        pick(F.col("l_quantity") >= 49, F.col("l_partkey") % 100).alias("body_refs"), F.max(F.col("l_returnflag") == "A").alias("g"))
    rows = rows.withColumn("summary_refs", F.col("title_refs")).withColumn("claim_refs", F.col("body_refs")).withColumn(
        "content_status", F.when(F.col("g"), "GROUNDED").otherwise("NO_SEMANTIC_EVIDENCE"))
    return closure.attribution_closure(rows, "l_orderkey", "l_orderkey")


@query("v7_visual_content", f"""
WITH b AS (SELECT sample_id, fact_id, fact_id % 5 AS content FROM v_facts WHERE is_key = 1), o AS (SELECT sample_id, fact_id % 5 AS content FROM v_facts WHERE supported = 0)
SELECT {_row('VISUAL_CONTENT', 'b.sample_id', 'b.fact_id', 'b.content')} FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.sample_id = b.sample_id AND o.content = b.content)""", "v_facts")
def _(t):
    chosen = t.v_facts.where("is_key = 1").select("sample_id", "fact_id", (F.col("fact_id") % 5).alias("content"))
    offered = t.v_facts.where("supported = 0").select("sample_id", (F.col("fact_id") % 5).alias("content")).distinct()
    missing = chosen.join(offered, ["sample_id", "content"], "left_anti")
    return closure.violation(missing, "VISUAL_CONTENT", F.col("sample_id"), F.col("fact_id"), F.col("content"))


@query("v8_relation_direction", f"""
SELECT {_row('RELATION_BACKWARD', 'user_id', 'event_id')} FROM events WHERE floor(value) <= 50""")
def _(t):
    edges = t.events.select("user_id", "event_id", F.lit(50).alias("from_ms"), F.floor("value").alias("to_ms"))
    return closure.violation(edges.where("to_ms <= from_ms"), "RELATION_BACKWARD", F.col("user_id"), F.col("event_id"))


@query("v9_schema_versions", f"""
WITH v AS (SELECT o_custkey, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1)
SELECT {_row('SCHEMA_VERSION', 'o_custkey', 'o_custkey', detail="CASE WHEN lo <> hi THEN 'MIXED' ELSE 'UNSUPPORTED' END")} FROM v WHERE lo <> hi OR lo <> 'F'""")
def _(t):
    versions = t.orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("lo"), F.max("o_orderstatus").alias("hi")).where("lo <> hi OR lo <> 'F'")
    return closure.violation(versions, "SCHEMA_VERSION", F.col("o_custkey"), F.col("o_custkey"), None, F.when(F.col("lo") != F.col("hi"), "MIXED").otherwise("UNSUPPORTED"))


@query("v10_observation_rules", f"""
WITH o AS (SELECT event_id, user_id, event_type = 'view' AS ind, event_id % 3 AS refs, event_id % 4 AS kind, event_id % 2 AS changes, event_id % 7 = 0 AS foreign_source FROM events),
v AS (SELECT *, CASE WHEN ind AND refs > 0 THEN 'INDEPENDENT_WITH_TRANSCRIPT' WHEN NOT ind AND refs = 0 THEN 'TRANSCRIPT_MISSING' WHEN kind = 1 AND changes > 0 THEN 'SAME_STATE_WITH_CHANGES'
   WHEN kind = 2 AND changes < 1 THEN 'CHANGE_WITHOUT_FIELDS' WHEN foreign_source THEN 'SOURCE_NOT_SHOWN' END AS r FROM o)
SELECT {_row('OBSERVATION', 'user_id', 'event_id', detail='r')} FROM v WHERE r IS NOT NULL""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in ("SEQUENCE", "SAME_STATE", "PARAMETER_CHANGE", "CAUSE")])
    e = F.col("event_id")
    rows = t.events.select(
        F.col("user_id").alias("run_id"), e.alias("observation_id"), F.when(F.col("event_type") == "view", "INDEPENDENT").otherwise("SUPPORTING").alias("relation"),
        F.array_repeat(e, (e % 3).cast("int")).alias("transcript_refs"),
        F.array(F.struct(F.element_at(kinds, (e % 4 + 1).cast("int")).alias("kind"), (e % 2).alias("changes"))).alias("frame_relations"),
        F.array(F.when(e % 7 == 0, -e - 1).otherwise(e)).alias("source_refs"), F.array(e).alias("keyframe_refs"))
    return closure.observation_rules(rows)


@query("v11_table_widths", f"""
SELECT {_row('TABLE_WIDTH', 'conv_id', 'turn')} FROM conversations WHERE len(list_filter(string_split(text, chr(10)), lambda r: len(string_split(r, ', ')) <> len(string_split(string_split(text, chr(10))[1], ', ')))) > 0""")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, ", "))
    tables = t.conversations.select("conv_id", "turn", lines.alias("rows"), F.get(lines, F.lit(0)).alias("columns"))
    return closure.table_widths(tables, "conv_id", "turn")


@query("v12_draft_rules", f"""
WITH d AS (SELECT w.run_id, w.start_ms, w.end_ms, w.chunk_index % 4 AS n, w.chunk_index % 3 AS mode, (w.end_ms - w.start_ms) // 8 AS span FROM v_windows w),
v AS (SELECT *, CASE WHEN end_ms - start_ms > 300000 THEN 'TOO_LONG' WHEN n > CASE WHEN mode = 2 THEN 4 ELSE 2 END THEN 'TOO_MANY_TARGETS' WHEN mode = 0 AND n > 0 THEN 'TARGETS_WITHOUT_MODE'
   WHEN mode = 2 AND n < 2 THEN 'TOO_FEW_TARGETS' WHEN span > 30000 THEN 'ANCHOR_SPAN' WHEN mode = 2 AND n > 1 THEN 'ANCHORS_OVERLAP' END AS r FROM d)
SELECT {_row('DRAFT', 'run_id', 'start_ms', detail='r')} FROM v WHERE r IS NOT NULL""", "v_windows")
def _(t):
    mode = F.element_at(F.array(F.lit("NONE"), F.lit("SINGLE"), F.lit("COMPARISON")), (F.col("chunk_index") % 3 + 1).cast("int"))
    rows = t.v_windows.select(
        "run_id", "start_ms", "end_ms", mode.alias("visual_mode"), F.array_repeat(F.array(F.lit("a")), (F.col("chunk_index") % 4).cast("int")).alias("anchors"),
        F.floor((F.col("end_ms") - F.col("start_ms")) / 8).alias("anchor_span_ms"))
    return closure.draft_rules(rows)


@query("v13_planning_closure", f"""
WITH a AS (SELECT run_id, seq AS pos, evidence_id AS ref FROM v_transcript), b AS (SELECT run_id, seq + 1 - min(seq) OVER (PARTITION BY run_id) AS pos, evidence_id AS ref FROM v_transcript)
SELECT {_row('ORDER', 'run_id', 'pos', 'a.ref', 'b.ref')} FROM a FULL JOIN b USING (run_id, pos) WHERE a.ref IS DISTINCT FROM b.ref""", "v_transcript")
def _(t):
    rows = t.v_transcript
    first = rows.groupBy("run_id").agg(F.min("seq").alias("lo"))
    given = rows.select("run_id", F.col("seq").alias("pos"), F.col("evidence_id").alias("ref"))
    expected = rows.join(first, "run_id").select("run_id", (F.col("seq") + 1 - F.col("lo")).alias("pos"), F.col("evidence_id").alias("ref"))
    return closure.positional_closure(given, expected, "run_id")


@query("v14_writing_response", f"""
WITH b AS (SELECT run_id, sum(length(text)) AS chars, count(*) AS refs, count(*) FILTER (WHERE role = 'system') AS foreign_refs FROM v_transcript GROUP BY 1)
SELECT {_row('WRITING', 'run_id', 'run_id', detail="CASE WHEN foreign_refs > 0 THEN 'REFERENCE_NOT_ALLOWED' ELSE 'BODY_TOO_LONG' END")} FROM b WHERE foreign_refs > 0 OR chars > 3000""", "v_transcript")
def _(t):
    body = t.v_transcript.groupBy("run_id").agg(F.sum(F.length("text")).alias("chars"), F.max(F.col("role") == "system").alias("foreign"))
    reason = F.when(F.col("foreign"), "REFERENCE_NOT_ALLOWED").when(F.col("chars") > 3000, "BODY_TOO_LONG")
    return closure.violation(body.withColumn("r", reason).where("r IS NOT NULL"), "WRITING", F.col("run_id"), F.col("run_id"), None, F.col("r"))


@query("v15_vision_response", f"""
WITH s AS (SELECT sample_id, count(*) AS selected, bool_or(supported = 0) AS foreign_frame, bool_or(is_key = 1) AS covered FROM v_facts GROUP BY 1)
SELECT {_row('VISION', 'sample_id', 'sample_id', detail="CASE WHEN foreign_frame THEN 'FRAME_NOT_ALLOWED' WHEN selected > 3 THEN 'TOO_MANY_FRAMES' ELSE 'TARGET_NOT_COVERED' END")} FROM s WHERE foreign_frame OR selected > 3 OR NOT covered""", "v_facts")
def _(t):
    rows = t.v_facts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("selected"), F.max(F.col("supported") == 0).alias("foreign"), F.max(F.col("is_key") == 1).alias("covered"))
    reason = F.when(F.col("foreign"), "FRAME_NOT_ALLOWED").when(F.col("selected") > 3, "TOO_MANY_FRAMES").when(~F.col("covered"), "TARGET_NOT_COVERED")
    return closure.violation(rows.withColumn("r", reason).where("r IS NOT NULL"), "VISION", F.col("sample_id"), F.col("sample_id"), None, F.col("r"))


@query("v16_transcript_source", f"""
WITH r AS (SELECT conv_id, min(role) AS lo, max(role) AS hi FROM conversations GROUP BY 1)
SELECT {_row('TRANSCRIPT_SOURCE', 'conv_id', 'conv_id', detail="CASE WHEN lo <> hi THEN 'MIXED' ELSE lo END")} FROM r WHERE lo <> hi OR lo <> 'user'""")
def _(t):
    kinds = t.conversations.groupBy("conv_id").agg(F.min("role").alias("lo"), F.max("role").alias("hi")).where("lo <> hi OR lo <> 'user'")
    return closure.violation(kinds, "TRANSCRIPT_SOURCE", F.col("conv_id"), F.col("conv_id"), None, F.when(F.col("lo") != F.col("hi"), "MIXED").otherwise(F.col("lo")))


@query("v17_terminal_contract", f"""
WITH r AS (SELECT event_id, status, CASE WHEN value > 5 THEN 'a' END AS artifact, CASE WHEN event_id % 4 = 0 THEN 'E' END AS failure, ts + (value - 30) * INTERVAL '1' SECOND < ts AS backward, value FROM v_jobs WHERE status IN ('SUCCEEDED', 'FAILED')),
v AS (SELECT *, CASE WHEN status = 'SUCCEEDED' AND (artifact IS NULL OR failure IS NOT NULL) THEN 'SUCCESS_CONTRACT' WHEN status = 'FAILED' AND (failure IS NULL OR artifact IS NOT NULL) THEN 'FAILURE_CONTRACT' WHEN value < 30 THEN 'TIME_ORDER' END AS r FROM r)
SELECT {_row('TERMINAL', 'event_id', 'event_id', detail='r')} FROM v WHERE r IS NOT NULL""", "v_jobs")
def _(t):
    runs = t.v_jobs.where("status IN ('SUCCEEDED', 'FAILED')").select(
        F.col("event_id").alias("run_id"), "status", F.when(F.col("value") > 5, "a").alias("artifact"), F.when(F.col("event_id") % 4 == 0, "E").alias("failure_code"),
        F.lit(30.0).alias("started_at"), F.col("value").alias("finished_at"))
    return closure.terminal_contract(runs)


@query("v18_annotation_terms", f"""
WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), n AS (SELECT doc_id, list_transform(lines, lambda x: {sql_norm('x')}) AS terms FROM w)
SELECT {_row('ANNOTATION', 'doc_id', 'doc_id', detail="CASE WHEN list_contains(terms, '') THEN 'BLANK_TERM' ELSE 'DUPLICATE_TERM' END")} FROM n WHERE list_contains(terms, '') OR len(list_distinct(terms)) <> len(terms)""")
def _(t):
    folded = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("term")).select("doc_id", normalize_text(F.col("term")).alias("term"))
    counts = folded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    flags = counts.groupBy("doc_id").agg(F.max(F.col("term") == "").alias("blank"), F.max(F.col("n") > 1).alias("twice")).where("blank OR twice")
    return closure.violation(flags, "ANNOTATION", F.col("doc_id"), F.col("doc_id"), None, F.when(F.col("blank"), "BLANK_TERM").otherwise("DUPLICATE_TERM"))


@query("v19_hint_pairs", f"""
WITH s AS (SELECT conv_id * 10 + turn // 2 AS pair_id, CASE WHEN turn % 2 = 0 THEN 'NONE' ELSE 'CORRECT' END AS variant, role AS language, conv_id % 9 + CASE WHEN length(text) > 900 THEN 1 ELSE 0 END AS media, length(text) % 2 = 0 AS has_hints FROM conversations),
f AS (SELECT pair_id, count(*) FILTER (WHERE variant = 'NONE') AS none, count(*) FILTER (WHERE variant = 'CORRECT') AS correct, count(*) AS n, min(language) <> max(language) AS ld, min(media) <> max(media) AS md, bool_or(variant = 'NONE' AND has_hints) AS hinted FROM s GROUP BY 1),
v AS (SELECT *, CASE WHEN none <> 1 OR correct <> 1 OR n <> 2 THEN 'VARIANTS' WHEN ld THEN 'LANGUAGE' WHEN md THEN 'MEDIA' WHEN hinted THEN 'NONE_WITH_HINTS' END AS r FROM f)
SELECT {_row('HINT_PAIR', 'pair_id', 'pair_id', detail='r')} FROM v WHERE r IS NOT NULL""")
def _(t):
    samples = t.conversations.select(
        (F.col("conv_id") * 10 + F.floor(F.col("turn") / 2)).alias("pair_id"), F.when(F.col("turn") % 2 == 0, "NONE").otherwise("CORRECT").alias("variant"),
        F.col("role").alias("language"), (F.col("conv_id") % 9 + F.when(F.length("text") > 900, 1).otherwise(0)).alias("media"), (F.length("text") % 2 == 0).alias("has_hints"))
    return closure.hint_pair_rules(samples)


@query("v20_judgment_coverage", f"""
WITH a AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id)), b AS (SELECT DISTINCT lang, doc_id FROM documents WHERE n_chars % 2 = 0)
SELECT {_row('COVERAGE', 'lang', 'doc_id', detail="CASE WHEN a.doc_id IS NULL THEN 'MISSING' ELSE 'UNEXPECTED' END").replace("coalesce(CAST(doc_id", "coalesce(CAST(coalesce(a.doc_id, b.doc_id)").replace("CAST(lang AS", "CAST(coalesce(a.lang, b.lang) AS")} FROM a FULL JOIN b ON a.lang = b.lang AND a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def _(t):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    judged = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return closure.coverage_rules(judged, docs.where("n_chars % 2 = 0"), "lang", "doc_id")


@query("v21_metric_maps", f"""
WITH m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS extra, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)
SELECT {_row('METRICS', 'user_id', 'user_id', detail="CASE WHEN extra > 0 THEN 'UNKNOWN_METRIC' ELSE 'MISSING_METRIC' END")} FROM m WHERE extra > 0 OR views = 0 OR clicks = 0""")
def _(t):
    kinds = t.events.where("event_type IN ('purchase', 'view', 'click')").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    everyone = t.events.select("user_id").distinct()
    maps = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    rows = everyone.join(maps, "user_id", "left").select("user_id", F.coalesce("m", F.create_map().cast("map<string,bigint>")).alias("metrics"))
    return closure.metric_map_rules(rows, "user_id", ["view", "click"])


@query("v22_durability", f"""
WITH s AS (SELECT user_id, event_id, value, event_type, event_id % 5 AS k FROM events),
v AS (SELECT *, CASE WHEN event_type = 'error' THEN 'NOT_SUCCEEDED' WHEN value > 300 THEN 'RTF' WHEN k = 1 THEN 'OUT_OF_MEMORY' WHEN k = 2 THEN 'CONCURRENCY' WHEN k = 3 THEN 'OUTSIDE_WRITES' END AS r FROM s)
SELECT {_row('DURABILITY', 'user_id', 'event_id', detail='r')} FROM v WHERE r IS NOT NULL""")
def _(t):
    k = F.col("event_id") % 5
    samples = t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("sample_id"), (F.col("event_type") != "error").alias("succeeded"), F.col("value").alias("elapsed_seconds"),
        F.lit(100_000).alias("duration_ms"), (F.col("value") / 100.0).alias("rtf"), (k == 1).alias("oom_detected"), F.when(k == 2, 2).otherwise(1).alias("peak_concurrency"),
        F.when(k == 3, 1).otherwise(0).alias("outside_writes"))
    return closure.durability_rules(samples)
