"""Quality metric and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions.text import nfkc, normalize_text
from spanledger.operators import history, lookups, matching, quality, segmentation
from spanledger.operators.lookups import ordered_refs
from spanledger.plans.catalog import query
from spanledger.plans.views import sql_bytes_any, sql_bytes_lower, sql_norm
from spanledger.session import checkpoint, spread

RUN = ["run_id"]
_BARE = lambda c: f"replace({sql_norm(c)}, ' ', '')"
_CER = f"levenshtein({sql_bytes_lower(_BARE('hypothesis'))}, {sql_bytes_lower(_BARE('reference'))})"
_UNITS = f"length({_BARE('reference')})"


def pairs(t):
    """Pairs spread evenly: edit distance is quadratic in the text length."""
    return spread(t.v_pairs, "run_id", "turn")


def character_rows(t):
    errors, units = quality.character_counts(F.col("hypothesis"), F.col("reference"))
    return pairs(t).select("run_id", "turn", "lang", errors.alias("errors"), units.alias("units"))


@query("m1_character_errors", f"""
SELECT run_id, turn, {_CER} AS errors, {_UNITS} AS units, round({_CER} / {_UNITS}, 9) AS cer FROM v_pairs""", "v_pairs")
def _(t):
    rows = character_rows(t).drop("lang")
    return rows.withColumn("cer", F.round(quality.rate(F.col("errors"), F.col("units")), 9))


@query("m2_word_errors", f"""
WITH n AS (SELECT run_id, turn, {sql_norm('hypothesis')} AS h, {sql_norm('reference')} AS r FROM v_pairs),
w AS (SELECT run_id, turn, CASE WHEN h = '' THEN [] ELSE string_split(h, ' ') END AS h, CASE WHEN r = '' THEN [] ELSE string_split(r, ' ') END AS r FROM n),
s AS (SELECT *, list_intersect(h, r) AS common FROM w),
c AS (SELECT run_id, turn, len(r) AS units, len(common) AS shared, array_to_string(list_transform(h, lambda x: chr(CAST(coalesce(list_position(common, x), 0) + 2 AS INTEGER))), '') AS h,
             array_to_string(list_transform(r, lambda x: CASE WHEN list_contains(common, x) THEN chr(CAST(list_position(common, x) + 2 AS INTEGER)) ELSE chr(1) END), '') AS r FROM s)
SELECT run_id, turn, levenshtein(h, r) AS errors, units, round(CASE WHEN units = 0 THEN CASE WHEN h = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(h, r) / units END, 9) AS wer FROM c""", "v_pairs")
def _(t):
    rows = quality.word_error_rows(pairs(t), ["run_id", "turn"])
    return rows.withColumn("wer", F.round(quality.rate(F.col("errors"), F.col("units")), 9))


@query("m3_exact_character_errors", f"""
SELECT run_id, turn, levenshtein({sql_bytes_any('hypothesis')}, {sql_bytes_any('reference')}) AS errors, length(reference) AS units FROM v_pairs""", "v_pairs")
def _(t):
    errors, units = quality.exact_character_counts(F.col("hypothesis"), F.col("reference"))
    return pairs(t).select("run_id", "turn", errors.alias("errors"), units.alias("units"))


def points(t):
    rows = t.v_spans.select("run_id", "event_type", F.col("start_ms").alias("timestamp_ms"))
    return rows.where("event_type IN ('view', 'click')"), rows.where("event_type NOT IN ('view', 'click')")


_M4 = """
r AS (SELECT run_id, start_ms AS ts, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, event_id) AS i FROM v_spans WHERE event_type IN ('view', 'click')),
h AS (SELECT run_id, start_ms AS ts, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, event_id) AS j FROM v_spans WHERE event_type NOT IN ('view', 'click')),
nr AS (SELECT run_id, count(*) AS nr FROM r GROUP BY 1), nh AS (SELECT run_id, count(*) AS nh FROM h GROUP BY 1),
w AS (SELECT nr.run_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS m FROM nr JOIN nh USING (run_id)
      UNION ALL
      SELECT w.run_id, CASE WHEN h.ts < r.ts - 7200000 THEN w.i ELSE w.i + 1 END, CASE WHEN h.ts <= r.ts + 7200000 THEN w.j + 1 ELSE w.j END,
             CASE WHEN abs(h.ts - r.ts) <= 7200000 THEN w.m + 1 ELSE w.m END
      FROM w JOIN r ON r.run_id = w.run_id AND r.i = w.i JOIN h ON h.run_id = w.run_id AND h.j = w.j),
best AS (SELECT run_id, max(m) AS m FROM w GROUP BY run_id),
cnt AS (SELECT run_id, coalesce(best.m, 0) AS matches, coalesce(nh, 0) AS predicted, coalesce(nr, 0) AS reference FROM nr FULL JOIN nh USING (run_id) LEFT JOIN best USING (run_id))"""


def boundary_rows(t):
    reference, hypothesis = points(t)
    return matching.boundary_counts(reference, hypothesis, RUN, 7_200_000)


@query("m4_boundary_f1", f"""
WITH RECURSIVE {_M4} SELECT run_id, matches, predicted, reference, round(CASE WHEN predicted = 0 AND reference = 0 THEN 1 WHEN matches = 0 THEN 0 ELSE 2.0 * matches / (predicted + reference) END, 9) AS f1 FROM cnt""", "v_spans")
def _(t):
    rows = boundary_rows(t)
    return rows.withColumn("f1", F.round(matching.f1(F.col("matches"), F.col("predicted"), F.col("reference")), 9))


@query("a2_pooled_f1", f"""
WITH RECURSIVE {_M4} SELECT CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(reference) AS BIGINT) AS reference, round(2.0 * sum(matches) / (sum(predicted) + sum(reference)), 9) AS f1 FROM cnt""", "v_spans")
def _(t):
    pooled = boundary_rows(t).agg(*[F.sum(c).alias(c) for c in ("matches", "predicted", "reference")])
    return pooled.withColumn("f1", F.round(matching.f1(F.col("matches"), F.col("predicted"), F.col("reference")), 9))


def interval_sides(t):
    rows = t.v_spans.select("run_id", "event_type", "start_ms", "end_ms")
    return rows.where("event_type IN ('view', 'click')").drop("event_type"), rows.where("event_type NOT IN ('view', 'click')").drop("event_type")


def _assignment(island: str, edge: str, weight: str) -> str:
    """SQL of the heaviest matching of each island: references take a free partner or none, one after the other."""
    return f"""
iv AS (SELECT run_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS side, start_ms, end_ms, row_number() OVER () AS id FROM v_spans),
mk AS (SELECT *, CASE WHEN start_ms > {island} THEN 1 ELSE 0 END AS opens FROM iv), il AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, id) AS island FROM mk),
eg AS (SELECT r.run_id, r.island, r.id AS r, h.id AS h, {weight} AS w FROM il r JOIN il h ON r.run_id = h.run_id AND r.island = h.island AND r.side = 0 AND h.side = 1 AND {edge}),
nb AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, island ORDER BY r) AS i FROM eg), op AS (SELECT run_id, island, i, h, w FROM nb UNION ALL SELECT DISTINCT run_id, island, i, CAST(NULL AS BIGINT), 0 FROM nb),
st AS (SELECT DISTINCT run_id, island, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS total FROM nb
       UNION SELECT st.run_id, st.island, st.i + 1, CASE WHEN h IS NULL THEN used ELSE list_sort(list_append(used, h)) END, CAST(total + w AS BIGINT) FROM st JOIN op ON op.run_id = st.run_id AND op.island = st.island AND op.i = st.i + 1 WHERE h IS NULL OR NOT list_contains(used, h)),
bs AS (SELECT run_id, island, max(total) AS m FROM st GROUP BY ALL), rn AS (SELECT run_id, CAST(sum(m) AS BIGINT) AS m FROM bs GROUP BY run_id),
ct AS (SELECT run_id, count(*) FILTER (side = 1) AS predicted, count(*) FILTER (side = 0) AS reference, CAST(coalesce(sum(end_ms - start_ms) FILTER (side = 0), 0) AS BIGINT) AS reference_ms FROM iv GROUP BY run_id)"""


_M5 = _assignment("coalesce(lag(start_ms) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, id) + 5400000, -1)", "abs(r.start_ms - h.start_ms) <= 5400000 AND abs(r.end_ms - h.end_ms) <= 5400000", "1")
_M6 = _assignment("coalesce(max(end_ms) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)",
                  "r.start_ms < h.end_ms AND h.start_ms < r.end_ms", "least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)")


@query("m5_interval_matches", f"WITH RECURSIVE {_M5} SELECT run_id, coalesce(m, 0) AS matches, predicted, reference FROM ct LEFT JOIN rn USING (run_id)", "v_spans")
def _(t):
    reference, hypothesis = interval_sides(t)
    return matching.interval_counts(reference, hypothesis, RUN, 5_400_000)


@query("m6_interval_error", f"""
WITH RECURSIVE {_M6} SELECT run_id, coalesce(m, 0) AS matched_ms, reference_ms, round(CASE WHEN reference_ms = 0 THEN CASE WHEN predicted = 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0.0, 1 - coalesce(m, 0) / reference_ms) END, 9) AS error_rate
FROM ct LEFT JOIN rn USING (run_id)""", "v_spans")
def _(t):
    reference, hypothesis = interval_sides(t)
    out = matching.interval_error(reference, hypothesis, RUN)
    return out.withColumn("error_rate", F.round("error_rate", 9))


def fact_rows(t):
    return t.v_facts.withColumn("predicted", F.lit(1).cast("bigint"))


@query("m7_fact_scores", """
SELECT sample_id, round(sum(supported) / count(*), 9) AS support_rate, round(CASE WHEN sum(is_key) = 0 THEN 1.0 ELSE sum(is_key * supported) / sum(is_key) END, 9) AS key_fact_recall FROM v_facts GROUP BY sample_id""", "v_facts")
def _(t):
    out = quality.fact_scores(fact_rows(t), ["sample_id"])
    return out.select("sample_id", F.round("support_rate", 9).alias("support_rate"), F.round("key_fact_recall", 9).alias("key_fact_recall"))


@query("m8_item_accuracy", f"""
WITH w AS (SELECT run_id, turn, string_split({sql_norm('reference')}, ' ') AS a, string_split({sql_norm('hypothesis')}, ' ') AS b FROM v_pairs)
SELECT run_id, turn, round(len(list_filter(list_zip(a, b), lambda p: p[1] = p[2])) / greatest(len(a), len(b)), 9) AS accuracy FROM w""", "v_pairs")
def _(t):
    words = t.v_pairs.select("run_id", "turn", F.split(normalize_text(F.col("reference")), " ").alias("a"), F.split(normalize_text(F.col("hypothesis")), " ").alias("b"))
    return words.select("run_id", "turn", F.round(quality.item_accuracy(F.col("a"), F.col("b")), 9).alias("accuracy"))


_TERMS = f"list_distinct(list_filter(string_split({sql_norm('reference')}, ' '), lambda w: length(w) >= 7))"


def terms_of(reference):
    return F.array_distinct(F.filter(F.split(reference, " "), lambda w: F.length(w) >= 7))


@query("m9_term_recall", f"""
WITH w AS (SELECT run_id, turn, {_TERMS} AS terms, {sql_norm('hypothesis')} AS h FROM v_pairs)
SELECT run_id, turn, CASE WHEN len(terms) > 0 THEN round(len(list_filter(terms, lambda x: contains(h, x))) / len(terms), 9) END AS recall FROM w""", "v_pairs")
def _(t):
    rows = t.v_pairs.select("run_id", "turn", normalize_text(F.col("hypothesis")).alias("h"), normalize_text(F.col("reference")).alias("r"))
    rows = rows.select("run_id", "turn", "h", terms_of(F.col("r")).alias("terms"))
    return rows.select("run_id", "turn", F.round(quality.term_recall(F.col("h"), F.col("terms")), 9).alias("recall"))


@query("m10_transcript_text", """
SELECT run_id, string_agg(text, ' ' ORDER BY start_ms, end_ms, evidence_id) AS transcript FROM v_transcript WHERE role = 'assistant' GROUP BY run_id""", "v_transcript")
def _(t):
    admitted = t.v_transcript.withColumn("evidence_type", F.lit("ASR_SEGMENT"))
    spoken = admitted.where("role = 'assistant'").withColumn("at", F.struct("start_ms", "end_ms", "evidence_id"))
    return ordered_refs(spoken, RUN, "at", "text").select("run_id", F.array_join("values", " ").alias("transcript"))


@query("m11_paired_hint_effect", f"""
WITH p AS (SELECT a.run_id, a.turn, a.reference, a.hypothesis AS n, b.hypothesis AS c FROM v_pairs a JOIN v_pairs b ON b.run_id = a.run_id AND b.turn = a.turn + 1),
s AS (SELECT run_id, turn, {_TERMS} AS terms, {sql_norm('n')} AS hn, {sql_norm('c')} AS hc, levenshtein({sql_bytes_lower(_BARE('n'))}, {sql_bytes_lower(_BARE('reference'))}) AS en,
             levenshtein({sql_bytes_lower(_BARE('c'))}, {sql_bytes_lower(_BARE('reference'))}) AS ec, {_UNITS} AS u FROM p)
SELECT run_id, turn, len(terms) AS term_count, round((len(list_filter(terms, lambda x: contains(hc, x))) - len(list_filter(terms, lambda x: contains(hn, x)))) / len(terms), 9) AS term_recall_delta,
       round((ec - en) / u, 9) AS error_rate_delta FROM s WHERE len(terms) > 0""", "v_pairs")
def _(t):
    none = t.v_pairs.select("run_id", "turn", "reference", F.col("hypothesis").alias("n"))
    correct = t.v_pairs.select("run_id", (F.col("turn") - 1).alias("turn"), F.col("hypothesis").alias("c"))
    triples = spread(none.join(correct, ["run_id", "turn"]), "run_id", "turn")
    en, units = quality.character_counts(F.col("n"), F.col("reference"))
    ec, _ = quality.character_counts(F.col("c"), F.col("reference"))
    rows = triples.select("run_id", "turn", en.alias("en"), ec.alias("ec"), units.alias("u"), normalize_text(F.col("n")).alias("hn"),
                        normalize_text(F.col("c")).alias("hc"), terms_of(normalize_text(F.col("reference"))).alias("terms"))
    recall = quality.term_recall(F.col("hc"), F.col("terms")) - quality.term_recall(F.col("hn"), F.col("terms"))
    return rows.where(F.size("terms") > 0).select(
        "run_id", "turn", F.size("terms").cast("bigint").alias("term_count"), F.round(recall, 9).alias("term_recall_delta"),
        F.round((F.col("ec") - F.col("en")) / F.col("u"), 9).alias("error_rate_delta"))


@query("a1_micro_error_rates", f"""
SELECT lang, CAST(sum({_CER}) AS BIGINT) AS errors, CAST(sum({_UNITS}) AS BIGINT) AS units, round(sum({_CER}) / sum({_UNITS}), 9) AS value, '' AS not_run_reason FROM v_pairs GROUP BY lang""", "v_pairs")
def _(t):
    out = quality.micro_average(character_rows(t), ["lang"])
    return out.withColumn("value", F.round("value", 9))


def scored(t):
    """Observations of one evaluation: error rates, boundary F1, fact scores and counts."""
    words, units = quality.word_counts(F.col("hypothesis"), F.col("reference"))
    chars, char_units = quality.character_counts(F.col("hypothesis"), F.col("reference"))
    by_char = pairs(t).where(F.col("lang").isin(quality.CHARACTER_LANGUAGES)).select("lang", chars.alias("errors"), char_units.alias("units"))
    by_word = pairs(t).where(F.col("lang").isin("en", "es")).select("lang", words.alias("errors"), units.alias("units"))
    names = F.create_map(*[F.lit(x) for kv in quality.METRIC_OF_LANGUAGE.items() for x in kv])
    rates = quality.micro_average(by_char.unionByName(by_word), ["lang"]).select(names[F.col("lang")].alias("metric"), "value")
    pooled = boundary_rows(t).agg(*[F.sum(c).alias(c) for c in ("matches", "predicted", "reference")])
    boundary = pooled.select(F.lit("semantic_boundary_f1").alias("metric"), matching.f1(F.col("matches"), F.col("predicted"), F.col("reference")).alias("value"))
    facts = quality.fact_scores(fact_rows(t).withColumn("all", F.lit(1)), ["all"])
    support = facts.select(F.lit("fact_support_rate").alias("metric"), F.col("support_rate").alias("value"))
    recall = facts.select(F.lit("key_fact_recall").alias("metric"), F.col("key_fact_recall").alias("value"))
    unknown = lookups.unknown_refs(t.lineitem.select("l_partkey"), t.part, "l_partkey", "p_partkey").agg(
        F.lit("unknown_evidence_count").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    valid = t.labels.agg(F.lit("schema_time_valid_rate").alias("metric"), F.avg(F.col("quality").cast("double")).alias("value"))
    out = rates
    for part in (boundary, support, recall, unknown, valid):
        out = out.unionByName(part)
    return quality.evaluate_thresholds(out)


@query("m12_quality_report")
def _(t):
    return scored(t).withColumn("value", F.round("value", 9))


_THRESHOLDS = "th AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {v}::DOUBLE, '{d}')" for m, v, d in quality.THRESHOLDS) + ") AS x(metric, threshold, direction))"
_OBS = """ob AS (SELECT 'fact_support_rate' AS metric, sum(supported) / count(*) AS value FROM v_facts UNION ALL SELECT 'key_fact_recall', sum(is_key * supported) / sum(is_key) FROM v_facts
 UNION ALL SELECT 'unlisted', 1.0 UNION ALL SELECT 'rtf', 2.5),
ev AS (SELECT metric, value, threshold, direction, CASE WHEN threshold IS NULL THEN 'UNKNOWN_METRIC' WHEN value IS NULL THEN 'NOT_RUN' WHEN (direction = 'max' AND value <= threshold) OR (direction = 'min' AND value >= threshold) THEN 'PASS' ELSE 'FAIL' END AS status FROM th FULL JOIN ob USING (metric))"""


def threshold_rows(t):
    facts = quality.fact_scores(fact_rows(t).withColumn("all", F.lit(1)), ["all"])
    observed = facts.select(F.explode(F.create_map(
        F.lit("fact_support_rate"), "support_rate", F.lit("key_fact_recall"), "key_fact_recall", F.lit("unlisted"), F.lit(1.0), F.lit("rtf"), F.lit(2.5))).alias("metric", "value"))
    return quality.evaluate_thresholds(observed)


@query("m13_threshold_evaluation", f"WITH {_THRESHOLDS}, {_OBS} SELECT metric, round(value, 9) AS value, threshold, direction, status FROM ev", "v_facts")
def _(t):
    return threshold_rows(t).withColumn("value", F.round("value", 9))


@query("m13_overall_status", f"WITH {_THRESHOLDS}, {_OBS} SELECT CASE WHEN bool_or(status IN ('FAIL', 'UNKNOWN_METRIC')) THEN 'FAIL' WHEN bool_or(status = 'NOT_RUN') THEN 'NOT_RUN' ELSE 'PASS' END AS status FROM ev", "v_facts")
def _(t):
    return quality.overall_status(threshold_rows(t))


@query("m14_visual_text_facts", f"""
WITH j AS (SELECT run_id, string_agg(reference, chr(10) ORDER BY turn) AS reference, string_agg(hypothesis, chr(10) ORDER BY turn) AS hypothesis, list_distinct(list(reference)) AS fields FROM v_pairs GROUP BY run_id)
SELECT run_id, levenshtein({sql_bytes_any('hypothesis')}, {sql_bytes_any('reference')}) AS errors, length(reference) AS reference_units, len(list_filter(fields, lambda f: contains(hypothesis, f))) AS key_field_matches, len(fields) AS key_field_units FROM j""", "v_pairs")
def _(t):
    joined = ordered_refs(pairs(t), RUN, "turn", F.struct("reference", "hypothesis")).select(
        "run_id", F.array_join(F.transform("values", lambda v: v["reference"]), "\n").alias("reference"),
        F.array_join(F.transform("values", lambda v: v["hypothesis"]), "\n").alias("hypothesis"),
        F.array_distinct(F.transform("values", lambda v: v["reference"])).alias("fields"))
    joined = joined.withColumn("shown", nfkc(F.col("hypothesis")))
    errors, units = quality.exact_character_counts(F.col("hypothesis"), F.col("reference"))
    return joined.select(
        "run_id", errors.alias("errors"), units.alias("reference_units"),
        F.size(F.filter("fields", lambda f: F.contains("shown", f))).cast("bigint").alias("key_field_matches"), F.size("fields").cast("bigint").alias("key_field_units"))


@query("m15_visual_report_status", """
WITH p AS (SELECT o_orderkey AS case_id, o_custkey AS report FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT l_orderkey AS case_id, CASE WHEN max(l_quantity) < 10 THEN 'FAIL' WHEN min(l_quantity) > 45 THEN 'NOT_RUN' ELSE 'SUCCEEDED' END AS s, o_custkey AS report FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 2 GROUP BY ALL),
j AS (SELECT coalesce(p.report, r.report) AS report, p.case_id AS pc, r.case_id AS rc, s FROM p FULL JOIN r ON p.case_id = r.case_id)
SELECT report, count(pc) AS planned, count(*) FILTER (WHERE rc IS NULL) AS missing, count(*) FILTER (WHERE pc IS NULL) AS refused,
   CASE WHEN count(*) FILTER (WHERE pc IS NULL) > 0 THEN 'REFUSED' WHEN count(*) FILTER (WHERE rc IS NULL) > 0 THEN 'INCOMPLETE' WHEN bool_and(s = 'NOT_RUN') THEN 'NOT_RUN'
   WHEN bool_or(s IN ('FAIL', 'NOT_RUN')) THEN 'FAIL' ELSE 'SUCCEEDED' END AS status FROM j GROUP BY report""")
def _(t):
    owner = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("report"))
    lines = t.lineitem.where("l_quantity > 2").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"))
    status = F.when(F.col("hi") < 10, "FAIL").when(F.col("lo") > 45, "NOT_RUN").otherwise("SUCCEEDED")
    results = lines.join(owner, "case_id").select("report", "case_id", status.alias("case_status"))
    return quality.report_status(owner.where("case_id % 11 <> 0"), results, ["report"])


@query("m16_resolution_decision", """
WITH c AS (SELECT sample_id, CASE WHEN fact_id % 2 = 0 THEN 'a' ELSE 'b' END AS cfg, sum(supported) / count(*) AS tv, sum(is_key) / count(*) AS kv FROM v_facts GROUP BY ALL),
w AS (SELECT sample_id, max(tv) FILTER (WHERE cfg = 'a') AS t0, max(tv) FILTER (WHERE cfg = 'b') AS t1, max(kv) FILTER (WHERE cfg = 'a') AS k0, max(kv) FILTER (WHERE cfg = 'b') AS k1 FROM c GROUP BY 1)
SELECT sample_id, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 'INCONCLUSIVE' WHEN (t1 > t0 OR k1 > k0) AND NOT (t1 < t0 OR k1 < k0) THEN 'KEEP_1920' WHEN NOT (t1 > t0 OR k1 > k0) THEN 'PREFER_1280' ELSE 'TRADEOFF_REVIEW_REQUIRED' END AS decision FROM w""", "v_facts")
def _(t):
    config = F.when(F.col("fact_id") % 2 == 0, "1280").otherwise("1920")
    results = t.v_facts.groupBy("sample_id", config.alias("config")).agg(F.avg("supported").alias("text_value"), F.avg("is_key").alias("key_value"))
    return quality.resolution_decision(results, ["sample_id"])


@query("m17_document_report")
def _(t):
    from spanledger.operators.chapters import contiguity_violations
    from spanledger.plans.documents import rendered, written

    runs = t.v_runs
    broken = contiguity_violations(t.v_windows, runs).select("run_id").distinct().withColumn("broken", F.lit(True))
    covered = F.sum(F.when(F.col("broken").isNull(), F.col("duration_ms")).otherwise(0))
    coverage = runs.join(broken, "run_id", "left").agg(
        F.lit("chapter_coverage").alias("metric"), (covered / F.sum("duration_ms")).alias("value"))
    rows, paragraphs = written(t)
    claims = rows.select("run_id", "chapter_index", F.posexplode("claims").alias("k", "c")).select(F.concat_ws("_", "run_id", "chapter_index", "k").alias("claim_id"), "c.evidence_refs")
    refs = claims.select("claim_id", F.explode("evidence_refs").alias("ref"))
    closure = quality.closure_rate(claims.select("claim_id"), refs, t.v_transcript.select(F.col("evidence_id").alias("ref"))).select(F.lit("claim_evidence_rate").alias("metric"), F.col("rate").alias("value"))
    stored = checkpoint(rendered(t, rows, paragraphs).select("run_id", F.sha2("content", 256).alias("stored")))
    again = rendered(t, rows, paragraphs).select("run_id", F.sha2("content", 256).alias("digest"))
    same = again.join(stored, "run_id").agg(F.lit("markdown_consistency").alias("metric"), F.min(F.when(F.col("digest") == F.col("stored"), 1.0).otherwise(0.0)).alias("value"))
    return coverage.unionByName(closure).unionByName(same).withColumn("status", F.when(F.col("value") == 1.0, "PASS").otherwise("FAIL"))


@query("m18_final_gate", """
WITH s AS (SELECT job_id, CASE status WHEN 'FAILED' THEN 'FAIL' WHEN 'PENDING' THEN 'NOT_RUN' ELSE 'PASS' END AS s FROM v_jobs)
SELECT CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'NOT_RUN') THEN 'NOT_RUN' ELSE 'PASS' END AS status, count(*) AS checks FROM s""", "v_jobs")
def _(t):
    status = F.when(F.col("status") == "FAILED", "FAIL").when(F.col("status") == "PENDING", "NOT_RUN").otherwise("PASS")
    return t.v_jobs.select(status.alias("s")).agg(history.worst_status("s").alias("status"), F.count(F.lit(1)).alias("checks"))
