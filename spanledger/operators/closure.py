"""Validation rules as violation rows ``(run_id, rule, entity_id, ref_id, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(rows: DataFrame, rule: str, run: Column, entity: Column, ref: Column | None = None, detail: Column | None = None) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    return rows.select(
        run.cast("string").alias("run_id"), F.lit(rule).alias("rule"), text(entity).alias("entity_id"), text(ref).alias("ref_id"),
        text(detail).alias("detail"))


def all_violations(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def duplicate_ids(rows: DataFrame, run: str, entity: str) -> DataFrame:
    counts = rows.groupBy(run, entity).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(counts, "DUPLICATE_ID", F.col(run), F.col(entity), None, F.col("n"))


def unknown_references(refs: DataFrame, known: DataFrame, run: str, entity: str, ref: str) -> DataFrame:
    missing = refs.join(known.select(F.col(known.columns[0]).alias(ref)).distinct(), ref, "left_anti")
    return violation(missing, "UNKNOWN_REFERENCE", F.col(run), F.col(entity), F.col(ref))


def type_mismatches(refs: DataFrame, typed: DataFrame, run: str, entity: str, ref: str, expected: str) -> DataFrame:
    """``typed``: (ref, evidence_type). References that resolve to another type."""
    wrong = refs.join(typed, ref).where(F.col("evidence_type") != expected)
    return violation(wrong, "TYPE_MISMATCH", F.col(run), F.col(entity), F.col(ref), F.col("evidence_type"))


def relation_policy(uses: DataFrame, run: str, entity: str) -> DataFrame:
    """DUPLICATE is never attributed; CONFLICTING only through a visual block with the same caption."""
    bad = (F.col("relation") == "DUPLICATE") | (
        (F.col("relation") == "CONFLICTING") & ~((F.col("block_type") == "VISUAL") & (F.col("caption") == F.col("observed_caption"))))
    return violation(uses.where(bad), "RELATION_POLICY", F.col(run), F.col(entity), None, F.col("relation"))


def attribution_closure(chapters: DataFrame, run: str, entity: str) -> DataFrame:
    """Reference rules of a chapter row (arrays of bounded size)."""
    used = F.array_distinct(F.concat("title_refs", "summary_refs", "body_refs", "claim_refs"))
    grounded = F.col("content_status") == "GROUNDED"
    reason = (
        F.when(F.size(F.array_distinct("evidence_refs")) != F.size("evidence_refs"), "DUPLICATE_REFERENCE")
        .when(F.size(F.array_except(used, "evidence_refs")) > 0, "REFERENCE_OUTSIDE_CHAPTER")
        .when(grounded & ((F.size("title_refs") == 0) | (F.size("summary_refs") == 0)), "HEADER_WITHOUT_REFERENCE")
        .when(~grounded & (F.size(F.concat("evidence_refs", used)) > 0), "EMPTY_CHAPTER_WITH_REFERENCES"))
    return violation(chapters.withColumn("__r", reason).where("__r IS NOT NULL"), "ATTRIBUTION", F.col(run), F.col(entity), None, F.col("__r"))


def observation_rules(observations: DataFrame) -> DataFrame:
    """Local rules of an observation: transcript refs by relation, change counts, sources."""
    independent = F.col("relation") == "INDEPENDENT"
    reason = (
        F.when(independent & (F.size("transcript_refs") > 0), "INDEPENDENT_WITH_TRANSCRIPT")
        .when(~independent & (F.size("transcript_refs") == 0), "TRANSCRIPT_MISSING")
        .when(F.exists("frame_relations", lambda r: (r["kind"] == "SAME_STATE") & (r["changes"] > 0)), "SAME_STATE_WITH_CHANGES")
        .when(F.exists("frame_relations", lambda r: (r["kind"] == "PARAMETER_CHANGE") & (r["changes"] < 1)), "CHANGE_WITHOUT_FIELDS")
        .when(F.size(F.array_except("source_refs", "keyframe_refs")) > 0, "SOURCE_NOT_SHOWN"))
    return violation(observations.withColumn("__r", reason).where("__r IS NOT NULL"), "OBSERVATION", F.col("run_id"), F.col("observation_id"), None, F.col("__r"))


def table_widths(tables: DataFrame, run: str, entity: str) -> DataFrame:
    ragged = tables.where(F.exists("rows", lambda r: F.size(r) != F.size("columns")))
    return violation(ragged, "TABLE_WIDTH", F.col(run), F.col(entity))


def draft_rules(drafts: DataFrame) -> DataFrame:
    """Length, target counts by mode, anchor span and disjoint anchor groups of a draft."""
    n = F.size("anchors")
    several = F.col("visual_mode").isin("COMPARISON", "MULTI_STEP")
    names = F.flatten("anchors")
    reason = (
        F.when(F.col("end_ms") - F.col("start_ms") > 300_000, "TOO_LONG").when(n > F.when(several, 4).otherwise(2), "TOO_MANY_TARGETS")
        .when((F.col("visual_mode") == "NONE") & (n > 0), "TARGETS_WITHOUT_MODE").when(several & (n < 2), "TOO_FEW_TARGETS")
        .when(F.col("anchor_span_ms") > 30_000, "ANCHOR_SPAN").when(several & (F.size(F.array_distinct(names)) != F.size(names)), "ANCHORS_OVERLAP"))
    return violation(drafts.withColumn("__r", reason).where("__r IS NOT NULL"), "DRAFT", F.col("run_id"), F.col("start_ms"), None, F.col("__r"))


def positional_closure(given: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """Both sides list ids by position; every differing, missing or extra position is reported."""
    a = given.select(run, "pos", F.col("ref").alias("__a"))
    b = expected.select(run, "pos", F.col("ref").alias("__b"))
    wrong = a.join(b, [run, "pos"], "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return violation(wrong, "ORDER", F.col(run), F.col("pos"), F.col("__a"), F.col("__b"))


def terminal_contract(runs: DataFrame) -> DataFrame:
    """Success needs every artifact and no failure code; failure the reverse; time must not run backwards."""
    success = F.col("status").isin("SUCCEEDED", "PARTIAL_SUCCEEDED")
    reason = (
        F.when(success & (F.col("artifact").isNull() | F.col("failure_code").isNotNull()), "SUCCESS_CONTRACT")
        .when(~success & (F.col("failure_code").isNull() | F.col("artifact").isNotNull()), "FAILURE_CONTRACT")
        .when(F.col("finished_at") < F.col("started_at"), "TIME_ORDER"))
    return violation(runs.withColumn("__r", reason).where("__r IS NOT NULL"), "TERMINAL", F.col("run_id"), F.col("run_id"), None, F.col("__r"))


def hint_pair_rules(samples: DataFrame) -> DataFrame:
    """Each pair has one NONE and one CORRECT sample of one language and media; NONE carries no hints."""
    flags = samples.groupBy("pair_id").agg(
        F.sum(F.when(F.col("variant") == "NONE", 1).otherwise(0)).alias("none"),
        F.sum(F.when(F.col("variant") == "CORRECT", 1).otherwise(0)).alias("correct"), F.count(F.lit(1)).alias("n"),
        (F.min("language") != F.max("language")).alias("language_differs"), (F.min("media") != F.max("media")).alias("media_differs"),
        F.max((F.col("variant") == "NONE") & F.col("has_hints")).alias("hinted"))
    reason = (
        F.when((F.col("none") != 1) | (F.col("correct") != 1) | (F.col("n") != 2), "VARIANTS").when(F.col("language_differs"), "LANGUAGE")
        .when(F.col("media_differs"), "MEDIA").when(F.col("hinted"), "NONE_WITH_HINTS"))
    return violation(flags.withColumn("__r", reason).where("__r IS NOT NULL"), "HINT_PAIR", F.col("pair_id"), F.col("pair_id"), None, F.col("__r"))


def coverage_rules(judged: DataFrame, required: DataFrame, run: str, ref: str) -> DataFrame:
    """Judgments must cover the required ids exactly."""
    a = judged.select(run, ref).distinct().withColumn("__a", F.lit(True))
    b = required.select(run, ref).distinct().withColumn("__b", F.lit(True))
    wrong = a.join(b, [run, ref], "full").where(F.col("__a").isNull() | F.col("__b").isNull())
    return violation(wrong, "COVERAGE", F.col(run), F.col(ref), None, F.when(F.col("__a").isNull(), "MISSING").otherwise("UNEXPECTED"))


def metric_map_rules(metrics: DataFrame, run: str, names: list[str]) -> DataFrame:
    """Closed key set and range of a metric map column ``metrics``."""
    keys = F.map_keys("metrics")
    wanted = F.array(*[F.lit(n) for n in names])
    reason = (
        F.when(F.size(F.array_except(keys, wanted)) > 0, "UNKNOWN_METRIC").when(F.size(F.array_except(wanted, keys)) > 0, "MISSING_METRIC")
        .when(F.exists(F.map_values("metrics"), lambda v: v < 0), "NEGATIVE"))
    return violation(metrics.withColumn("__r", reason).where("__r IS NOT NULL"), "METRICS", F.col(run), F.col(run), None, F.col("__r"))


def durability_rules(samples: DataFrame) -> DataFrame:
    """Limits on real-time factor, memory, concurrency and writes; the stored factor must match."""
    actual = F.col("elapsed_seconds") / (F.col("duration_ms") / 1000.0)
    reason = (
        F.when(~F.col("succeeded"), "NOT_SUCCEEDED").when(F.abs(actual - F.col("rtf")) > 1e-12, "RTF_MISMATCH").when(F.col("rtf") > 3.0, "RTF")
        .when(F.col("oom_detected"), "OUT_OF_MEMORY").when(F.col("peak_concurrency") != 1, "CONCURRENCY").when(F.col("outside_writes") > 0, "OUTSIDE_WRITES"))
    return violation(samples.withColumn("__r", reason).where("__r IS NOT NULL"), "DURABILITY", F.col("run_id"), F.col("sample_id"), None, F.col("__r"))
