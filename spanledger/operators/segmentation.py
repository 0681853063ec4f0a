"""Base segmentation of runs from their transcripts.

Every run comes out, whatever its size: rules that a run or a segment breaks are named in ``reason``.
Points, ranges and evidence meet in ordered scans over slices of the timeline, so a long or dense run is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions.identity import stable_id
from spanledger.operators.generate import grid_points
from spanledger.operators.scan import Scan, ordered_fold, ordered_scan, time_bucket
from spanledger.session import checkpoint

# Fixed values of the segmentation rules.
GRID_MS = 30_000
SPARSE_LIMIT = 16
SAMPLE_MS = 60_000
TOLERANCE_MS = 8_000
EMPTY_MAX_MS = 10_000
SEGMENT_MAX_MS = 300_000
REFS_MAX = 256
ITEMS_MAX = 20_000
CHARS_MAX = 2_000_000
#: Part of the timeline that one task scans.
SLICE_MS = 900_000


def transcript_budget(
    evidence: DataFrame, runs: DataFrame, items_max: int = ITEMS_MAX, chars_max: int = CHARS_MAX
) -> DataFrame:
    """One row per run with its totals and the first rule it breaks (empty when none)."""
    ids = evidence.groupBy("run_id", "evidence_id").agg(
        F.count(F.lit(1)).alias("copies"), F.sum(F.length("text")).alias("chars"),
        F.max("end_ms").alias("end_ms"), F.min("evidence_type").alias("t0"), F.max("evidence_type").alias("t1"),
    )
    totals = ids.groupBy("run_id").agg(
        F.sum("copies").alias("items"), F.sum("chars").alias("chars"), F.max("copies").alias("copies"),
        F.max("end_ms").alias("last_end_ms"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    reason = (
        F.when(F.col("items") > items_max, "TOO_MANY_ITEMS").when(F.col("chars") > chars_max, "TOO_MANY_CHARS")
        .when(F.col("copies") > 1, "DUPLICATE_EVIDENCE_ID")
        .when(F.col("last_end_ms") > F.col("duration_ms"), "EVIDENCE_OUTSIDE_TIMELINE")
        .when(F.col("t0") != F.col("t1"), "MIXED_EVIDENCE_TYPES").otherwise("")
    )
    return runs.join(totals, "run_id").select(
        "run_id", "duration_ms", "items", "chars", "last_end_ms", reason.alias("reason")
    )


def boundary_candidates(
    runs: DataFrame, silence_points: DataFrame | None, sentence_ends: DataFrame, language_changes: DataFrame | None,
    sentence_score: float = 0.8,
) -> DataFrame:
    """Distinct interior points with their source and score."""
    def scored(points: DataFrame, source: str, score: float) -> DataFrame:
        return points.select(
            "run_id", F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"),
            F.lit(source).alias("source"), F.lit(score).alias("score"),
        )

    parts = [scored(sentence_ends, "sentence_end", sentence_score)]
    if silence_points is not None:
        parts.append(scored(silence_points, "silence", 1.0))
    if language_changes is not None:
        parts.append(scored(language_changes, "language_change", 1.0))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    inside = union.join(runs.select("run_id", "duration_ms"), "run_id").where(
        (F.col("timestamp_ms") > 0) & (F.col("timestamp_ms") < F.col("duration_ms"))
    )
    return inside.select("run_id", "timestamp_ms", "source", "score").distinct()


def sample_sentence_ends(ends: DataFrame, runs: DataFrame) -> DataFrame:
    """All sentence ends of a run with few of them, else the best one per minute.

    The best is the one nearest to the end of its minute, or to the end of the run if that comes first. No admitted end
    lies beyond that point, so it is the latest: a maximum of longs finds it, and all ends meet their run in one join.
    """
    counts = ends.groupBy("run_id").agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.join(runs.select("run_id", "duration_ms"), "run_id", "left")
    rows = ends.select("run_id", "timestamp_ms").join(sizes.hint("shuffle_hash"), "run_id")
    few, slot = F.col("__n") <= SPARSE_LIMIT, F.floor(F.col("timestamp_ms") / SAMPLE_MS)
    target = F.least(F.col("duration_ms"), (slot + 1) * SAMPLE_MS)
    near = (target - F.col("timestamp_ms") <= TOLERANCE_MS) & (F.col("timestamp_ms") < F.col("duration_ms"))
    return rows.where(few | near).groupBy(
        "run_id", few.alias("__few"), F.when(few, F.col("timestamp_ms")).otherwise(slot).alias("__place")
    ).agg(F.max("timestamp_ms").alias("timestamp_ms")).select("run_id", "timestamp_ms")


def free_grid(runs: DataFrame, selected_ends: DataFrame) -> DataFrame:
    """Grid points farther than the tolerance from every selected sentence end.

    The tolerance is under half the grid step, so a sentence end can displace one
    grid point only and the test is an equality anti join.
    """
    grid = grid_points(runs, "run_id", "duration_ms", GRID_MS)
    near = (F.floor((F.col("timestamp_ms") + GRID_MS // 2) / GRID_MS) * GRID_MS).cast("bigint")
    displaced = selected_ends.where(F.abs(F.col("timestamp_ms") - near) <= TOLERANCE_MS).select(
        "run_id", near.alias("timestamp_ms")
    ).distinct()
    return grid.join(displaced, ["run_id", "timestamp_ms"], "left_anti")


def ordered_candidates(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct candidate points: free grid, strong points and sampled sentence ends."""
    ends = candidates.where((F.col("source") == "sentence_end") & (F.col("score") >= 0.8))
    selected = checkpoint(sample_sentence_ends(ends, runs))
    strong = candidates.where((F.col("source") != "sentence_end") | (F.col("score") >= 0.95))
    return (
        free_grid(runs, selected).unionByName(strong.select("run_id", "timestamp_ms")).unionByName(selected)
        .join(runs.select("run_id", "duration_ms"), "run_id")
        .where((F.col("timestamp_ms") > 0) & (F.col("timestamp_ms") < F.col("duration_ms")))
        .select("run_id", "timestamp_ms").distinct()
    )


def _scan(rows: DataFrame, order: list[str], *scans: Scan) -> DataFrame:
    return ordered_scan(rows, ["run_id"], order, time_bucket(order[0], SLICE_MS), list(scans))


def mark_safe(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add ``is_safe``: no evidence interval strictly contains the point."""
    extra = [c for c in points.columns if c not in ("run_id", "timestamp_ms")]
    tall = points.select(
        "run_id", F.col("timestamp_ms").alias("__at"), F.lit(0).alias("__kind"),
        F.lit(None).cast("bigint").alias("__end"), F.struct(F.lit(1), *extra).alias("__row"),
    ).unionByName(evidence.select(
        "run_id", F.col("start_ms").alias("__at"), F.lit(1).alias("__kind"), F.col("end_ms").alias("__end"),
    ), allowMissingColumns=True)
    scanned = _scan(tall, ["__at", "__kind"], Scan("__open", "max_before", "__end")).where("__kind = 0")
    return scanned.select(
        "run_id", F.col("__at").alias("timestamp_ms"), *[F.col(f"__row.{c}").alias(c) for c in extra],
        (F.coalesce("__open", F.lit(0)) <= F.col("__at")).alias("is_safe"),
    )


def safe_endpoints(evidence: DataFrame) -> DataFrame:
    ends = evidence.select("run_id", F.col("end_ms").alias("timestamp_ms")).distinct()
    return mark_safe(ends, evidence).where("is_safe").select("run_id", "timestamp_ms")


def snap_blocked_grid(marked: DataFrame, endpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nearest safe evidence end for each blocked grid point of densely spoken runs."""
    dense = evidence.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("evidence_type") == "ASR_SEGMENT").alias("spoken"),
        F.min(F.col("end_ms") - F.col("start_ms")).alias("shortest"),
    ).where("n >= 10 AND spoken AND shortest < 20000").select("run_id")
    blocked = marked.where(~F.col("is_safe") & (F.col("timestamp_ms") % GRID_MS == 0)).join(
        dense, "run_id", "left_semi"
    )
    none = F.lit(None).cast("bigint")
    tall = blocked.select("run_id", "timestamp_ms", F.lit(1).alias("__kind"), none.alias("__end")).unionByName(
        endpoints.select("run_id", "timestamp_ms", F.lit(0).alias("__kind"), F.col("timestamp_ms").alias("__end"))
    )
    near = _scan(tall, ["timestamp_ms", "__kind"], Scan("__left", "max_before", "__end"), Scan("__right", "min_after", "__end")).where("__kind = 1")
    left, right = F.col("timestamp_ms") - F.col("__left"), F.col("__right") - F.col("timestamp_ms")
    best = F.when(F.col("__right").isNull() | (left <= right), F.col("__left")).otherwise(F.col("__right"))
    return near.select("run_id", F.col("timestamp_ms").alias("grid_ms"), best.alias("timestamp_ms")).where(
        F.abs(F.col("timestamp_ms") - F.col("grid_ms")) <= TOLERANCE_MS
    )


def blocking_cues(candidates: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Safe interior edges of subtitle cues that strictly contain a candidate."""
    none = F.lit(None).cast("bigint")
    cues = evidence.where("evidence_type = 'SUBTITLE_CUE'")
    tall = cues.select(
        "run_id", F.col("start_ms").alias("__at"), F.lit(1).alias("__kind"), none.alias("__c"), "start_ms", "end_ms"
    ).unionByName(candidates.select(
        "run_id", F.col("timestamp_ms").alias("__at"), F.lit(0).alias("__kind"), F.col("timestamp_ms").alias("__c"),
    ), allowMissingColumns=True)
    hit = _scan(tall, ["__at", "__kind"], Scan("__next", "min_after", "__c")).where("__kind = 1 AND __next < end_ms")
    edges = hit.select("run_id", F.explode(F.array("start_ms", "end_ms")).alias("timestamp_ms")).distinct()
    inside = edges.join(runs.select("run_id", "duration_ms"), "run_id").where(
        "timestamp_ms > 0 AND timestamp_ms < duration_ms"
    ).drop("duration_ms")
    return mark_safe(inside, evidence).where("is_safe").select("run_id", "timestamp_ms")


def to_ranges(boundaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Consecutive ranges between 0, the boundaries and the end of each run."""
    points = runs.select(
        "run_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("duration_ms"))).alias("timestamp_ms")
    ).unionByName(boundaries.select("run_id", "timestamp_ms")).distinct()
    following = _scan(points, ["timestamp_ms"], Scan("end_ms", "lead", "timestamp_ms"))
    return following.select("run_id", F.col("timestamp_ms").alias("start_ms"), "end_ms").where("end_ms IS NOT NULL")


def split_oversize(ranges: DataFrame, endpoints: DataFrame, limit_ms: int = SEGMENT_MAX_MS) -> DataFrame:
    """Extra boundaries for ranges longer than the limit.

    From the left edge the latest safe end within the limit is taken, again and
    again. Ranges do not influence each other; the safe ends of each are walked in order.
    """
    long = ranges.where(F.col("end_ms") - F.col("start_ms") > limit_ms)
    edges = F.struct("start_ms", "end_ms")
    tall = long.select("run_id", F.col("start_ms").alias("timestamp_ms"), F.lit(0).alias("__kind"), edges.alias("__range")).unionByName(
        endpoints.select("run_id", "timestamp_ms", F.lit(1).alias("__kind")), allowMissingColumns=True
    )
    owned = _scan(tall, ["timestamp_ms", "__kind"], Scan("__own", "max_before", "__range"))
    inner = owned.where("__kind = 1 AND timestamp_ms > __own.start_ms AND timestamp_ms < __own.end_ms")
    ends = inner.select("run_id", F.col("__own.start_ms").alias("start_ms"), "timestamp_ms").unionByName(
        long.select("run_id", "start_ms", F.col("end_ms").alias("timestamp_ms")))

    def step(state: tuple, start: int, end: int) -> tuple:
        cur, last, stuck = state or (start, start, False)
        cut = end - cur > limit_ms and last > cur and not stuck
        cur = last if cut else cur
        return (cur, last if stuck else end, stuck or end - cur > limit_ms), cur if cut else None

    walked = ordered_fold(ends, ["run_id", "start_ms"], ["timestamp_ms"], ["start_ms", "timestamp_ms"], "cut_ms", tuple, step)
    return walked.where("cut_ms IS NOT NULL").select("run_id", F.col("cut_ms").alias("timestamp_ms"))


def assign_evidence(ranges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows with the range that covers their start (``range_start_ms``, ``range_end_ms``)."""
    columns = [c for c in evidence.columns if c != "run_id"]
    tall = evidence.select(
        "run_id", F.col("start_ms").alias("__at"), F.lit(1).alias("__kind"), F.struct(*columns).alias("__row")
    ).unionByName(ranges.select(
        "run_id", F.col("start_ms").alias("__at"), F.lit(0).alias("__kind"),
        F.struct("start_ms", "end_ms").alias("__range"),
    ), allowMissingColumns=True)
    owned = _scan(tall, ["__at", "__kind"], Scan("__o", "max_before", "__range")).where("__kind = 1")
    return owned.select(
        "run_id", "__row.*", F.col("__o.start_ms").alias("range_start_ms"), F.col("__o.end_ms").alias("range_end_ms")
    )


def merge_empty_ranges(ranges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Join short ranges without evidence to the range before them."""
    filled = assign_evidence(ranges, evidence).where("end_ms <= range_end_ms").select(
        "run_id", F.col("range_start_ms").alias("start_ms"), F.lit(True).alias("__filled")
    ).distinct()
    spoken = evidence.select("run_id").distinct().withColumn("__spoken", F.lit(True))
    marked = ranges.join(filled, ["run_id", "start_ms"], "left").join(spoken, "run_id", "left")
    joins_previous = (
        (F.col("end_ms") - F.col("start_ms") <= EMPTY_MAX_MS) & F.col("__filled").isNull()
        & F.col("__spoken").isNotNull() & (F.col("start_ms") > 0)
    )
    headed = _scan(marked.select("run_id", "start_ms", "end_ms", F.when(~joins_previous, F.col("start_ms")).alias("__own")), ["start_ms"], Scan("__before", "max_before", "__own"))
    return headed.select("run_id", F.coalesce("__own", "__before").alias("start_ms"), "end_ms").groupBy("run_id", "start_ms").agg(
        F.max("end_ms").alias("end_ms")
    )


def tested_points(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidate points and evidence ends in one staged table, with the flags ``candidate``, ``endpoint`` and ``is_safe``."""
    ends = evidence.select("run_id", F.col("end_ms").alias("timestamp_ms"))
    points = candidates.withColumn("candidate", F.lit(True)).withColumn("endpoint", F.lit(False)).unionByName(
        ends.withColumn("candidate", F.lit(False)).withColumn("endpoint", F.lit(True))
    ).groupBy("run_id", "timestamp_ms").agg(F.max("candidate").alias("candidate"), F.max("endpoint").alias("endpoint"))
    return checkpoint(mark_safe(checkpoint(points), evidence))


def safe_boundaries(runs: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """All boundaries after exclusion, snapping, cue edges and oversize splits.

    Candidate points and evidence ends are tested for safety together, so the evidence
    is shuffled once for both.
    """
    tested = tested_points(ordered_candidates(runs, candidates), evidence)
    marked = tested.where("candidate").select("run_id", "timestamp_ms", "is_safe")
    endpoints = tested.where("endpoint AND is_safe").select("run_id", "timestamp_ms")
    chosen = checkpoint(
        marked.where("is_safe").select("run_id", "timestamp_ms")
        .unionByName(snap_blocked_grid(marked, endpoints, evidence).select("run_id", "timestamp_ms"))
        .unionByName(blocking_cues(marked.select("run_id", "timestamp_ms"), evidence, runs)).distinct()
    )
    extra = split_oversize(to_ranges(chosen, runs), endpoints)
    return chosen.unionByName(extra).distinct()


def build_segments(runs: DataFrame, evidence: DataFrame, candidates: DataFrame, staged: bool = False) -> DataFrame:
    """Base segments with ordered evidence references and the rule they break, if any.

    No run is left out: a run that breaks a transcript rule has that rule as the reason of all its segments. The evidence (unless
    it is ``staged`` already), the tested points and the ranges are each used several times, so they are stage tables in the shared folder.
    Ranges are found and joined by times alone; joining an empty range to the one before adds no evidence, so the segments are known
    before a text moves, and texts are dealt to them once.
    """
    runs = checkpoint(runs.select("run_id", "duration_ms"))
    candidates = checkpoint(candidates)
    evidence = evidence if staged else checkpoint(evidence)
    times = evidence.select("run_id", "start_ms", "end_ms", "evidence_type")
    ranges = checkpoint(to_ranges(safe_boundaries(runs, times, candidates), runs))
    stats = assign_evidence(ranges, times).groupBy("run_id", F.col("range_start_ms").alias("start_ms")).agg(
        F.max(F.col("end_ms") > F.col("range_end_ms")).alias("straddles"))
    spoken = evidence.select("run_id").distinct().withColumn("__spoken", F.lit(True))
    broken = transcript_budget(evidence, runs).where("reason <> ''").select("run_id", F.col("reason").alias("run_reason"))
    joined = ranges.join(stats, ["run_id", "start_ms"], "left").join(spoken, "run_id", "left").join(runs, "run_id").join(broken, "run_id", "left")
    joins_previous = (
        (F.col("end_ms") - F.col("start_ms") <= EMPTY_MAX_MS) & F.col("straddles").isNull() & F.col("__spoken").isNotNull() & (F.col("start_ms") > 0)
    )
    heads = checkpoint(joined.where(~joins_previous).drop("end_ms", "__spoken"))
    following = _scan(heads, ["start_ms"], Scan("__next", "lead", "start_ms"))
    segments = checkpoint(following.withColumn("end_ms", F.coalesce("__next", "duration_ms")).drop("__next", "duration_ms"))
    packed = assign_evidence(segments, evidence.select("run_id", "start_ms", "end_ms", "evidence_id", "evidence_type", "text")).groupBy(
        "run_id", F.col("range_start_ms").alias("start_ms")).agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "evidence_id", "text"))).alias("rows"),
        F.max("evidence_type").alias("evidence_type"),
    )
    joined = segments.join(packed, ["run_id", "start_ms"], "left")
    source = (
        F.when(F.col("evidence_type").isNull(), "NONE").when(F.col("evidence_type") == "ASR_SEGMENT", "ASR")
        .otherwise("SUBTITLE")
    )
    refs = F.coalesce(F.transform("rows", lambda r: r["evidence_id"]), F.array().cast("array<string>"))
    joined = joined.withColumn("evidence_refs", refs)
    reason = (
        F.when(F.col("run_reason").isNotNull(), F.col("run_reason")).when(F.coalesce("straddles", F.lit(False)), "EVIDENCE_STRADDLES_BOUNDARY")
        .when(F.col("end_ms") - F.col("start_ms") > SEGMENT_MAX_MS, "NO_SAFE_BOUNDARY")
        .when(F.size("evidence_refs") > REFS_MAX, "TOO_MANY_REFERENCES").otherwise("")
    )
    return joined.select(
        "run_id",
        stable_id("segment", run_id=F.col("run_id"), start_ms=F.col("start_ms"), end_ms=F.col("end_ms"),
                  evidence_refs=F.col("evidence_refs")).alias("segment_id"),
        "start_ms", "end_ms", "evidence_refs",
        F.coalesce(F.array_join(F.transform("rows", lambda r: r["text"]), " "), F.lit("")).alias("text"),
        source.alias("transcript_source"), reason.alias("reason"),
    )
