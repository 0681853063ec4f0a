"""Base segmentation and chapters against straightforward per-run loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanledger.operators import chapters, segmentation

EVIDENCE = "run_id bigint, evidence_id string, start_ms bigint, end_ms bigint, text string, evidence_type string"


def reference_ranges(evidence, duration, kind, score):
    """Plain restatement of the segmentation rules for one run."""
    items = sorted((e[2], e[3], e[1]) for e in evidence)
    unsafe = lambda t: any(s < t < e for s, e, _ in items)
    ends = sorted({e for _, e, _ in items if 0 < e < duration})
    picked = list(ends)
    if len(ends) > 16:
        best = {}
        for e in ends:
            goal = min(duration, (e // 60_000 + 1) * 60_000)
            if abs(e - goal) <= 8_000:
                best[e // 60_000] = min(best.get(e // 60_000, (10**9, 0)), (abs(e - goal), e))
        picked = [v[1] for v in best.values()]
    grid = [g for g in range(30_000, duration, 30_000) if all(abs(g - p) > 8_000 for p in picked)]
    candidates = sorted(set(grid) | set(picked) | (set(ends) if score >= 0.95 else set()))
    safe = {c for c in candidates if not unsafe(c)}
    safe_ends = sorted({e for _, e, _ in items if not unsafe(e)})
    if kind == "ASR_SEGMENT" and len(items) >= 10 and any(e - s < 20_000 for s, e, _ in items):
        for c in candidates:
            if c % 30_000 == 0 and unsafe(c):
                near = min(((abs(e - c), e) for e in safe_ends if abs(e - c) <= 8_000), default=None)
                safe |= {near[1]} if near else set()
    if kind == "SUBTITLE_CUE":
        for s, e, _ in items:
            if any(s < c < e for c in candidates):
                safe |= {x for x in (s, e) if 0 < x < duration and not unsafe(x)}
    points = [0, *sorted(safe), duration]
    full = [0]
    for left, right in zip(points, points[1:]):
        while right - full[-1] > 300_000:
            reach = [e for e in safe_ends if full[-1] < e <= full[-1] + 300_000 and e < right]
            if not reach:
                return None
            full.append(reach[-1])
        full.append(right)
    ranges = list(zip(full, full[1:]))
    out = []
    for i, (s, e) in enumerate(ranges):
        empty = not any(s <= a and b <= e for a, b, _ in items)
        if items and i > 0 and e - s <= 10_000 and empty:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return [(s, e, tuple(x for a, b, x in items if s <= a and b <= e)) for s, e in out]


def transcript(rng, run, kind):
    rows, at = [], rng.randint(0, 20_000)
    style = rng.choice(["short", "long", "mixed"])
    for i in range(rng.randint(1, 60)):
        length = {"short": (800, 4_000), "long": (20_000, 120_000), "mixed": (1_000, 45_000)}[style]
        end = at + rng.randint(*length)
        rows.append((run, f"e{run}_{i:03d}", at, end, "x" * rng.randint(1, 9), kind))
        at = end + rng.choice([0, 0, 300, 5_000, 40_000])
    return rows


@pytest.mark.parametrize("kind,score", [("ASR_SEGMENT", 0.8), ("SUBTITLE_CUE", 1.0)])
def test_segments_match_loop(spark, kind, score):
    rng = random.Random(11 if kind == "ASR_SEGMENT" else 12)
    rows, durations = [], {}
    for run in range(40):
        mine = transcript(rng, run, kind)
        durations[run] = max(r[3] for r in mine) + rng.choice([0, 1_000, 70_000])
        rows += mine
    evidence = spark.createDataFrame(rows, EVIDENCE)
    runs = spark.createDataFrame(list(durations.items()), "run_id bigint, duration_ms bigint")
    ends = evidence.select("run_id", F.col("end_ms").alias("timestamp_ms"))
    candidates = segmentation.boundary_candidates(runs, None, ends, None, score)
    got = {}
    for r in segmentation.build_segments(runs, evidence, candidates).collect():
        got.setdefault(r.run_id, []).append((r.start_ms, r.end_ms, tuple(r.evidence_refs), r.reason))
    for run, duration in durations.items():
        want = reference_ranges([r for r in rows if r[0] == run], duration, kind, score)
        have = sorted(got[run])
        if want is None:
            assert any(h[3] == "NO_SAFE_BOUNDARY" for h in have)
            continue
        assert [h[:3] for h in have] == want
        assert all(h[3] == "" for h in have if len(h[2]) <= 256)


def test_grid_only_run(spark):
    runs = spark.createDataFrame([(1, 7_200_000), (2, 95_000)], "run_id bigint, duration_ms bigint")
    none = spark.createDataFrame([], "run_id bigint, timestamp_ms bigint")
    ranges = segmentation.to_ranges(segmentation.free_grid(runs, none), runs)
    assert {r.run_id: r["count"] for r in ranges.groupBy("run_id").count().collect()} == {1: 240, 2: 4}


def greedy_groups(segments, target):
    out, start = [], 0
    while start < len(segments):
        options = [i for i in range(start, len(segments)) if i == start or segments[i][1] - segments[start][0] <= 300_000]
        stop = next((i for i in options if i > start and segments[i][1] - segments[start][0] >= target), options[-1])
        if segments[start][1] - segments[start][0] >= target:
            stop = start
        best = min(range(start, stop + 1), key=lambda i: (abs(segments[i][1] - segments[start][0] - target), i))
        out.append(segments[start][0])
        start = best + 1
    return out


def test_near_target_groups(spark):
    rng = random.Random(21)
    rows, runs = [], {}
    for run in range(30):
        at, mine = 0, []
        for i in range(rng.randint(1, 40)):
            end = at + rng.randint(5_000, 280_000 if run % 3 == 0 else 70_000)
            mine.append((at, end))
            rows.append((run, f"s{i}", at, end, "t", "t"))
            at = end
        runs[run] = mine
    df = spark.createDataFrame(rows, "run_id bigint, segment_id string, start_ms bigint, end_ms bigint, text string, first_text string")
    for target in (120_000, 180_000, 300_000):
        got = {}
        for r in chapters.group_near_target(df, target).select("run_id", "group_start").distinct().collect():
            got.setdefault(r.run_id, []).append(r.group_start)
        for run, mine in runs.items():
            assert sorted(got[run]) == greedy_groups(mine, target)


def draft(start, end, mode="NONE", anchors=()):
    return {"run_id": 1, "start_ms": start, "end_ms": end, "title": str(start), "visual_mode": mode, "anchors": [list(a) for a in anchors], "members": 1}


def test_short_drafts_prefer_previous():
    out = chapters.absorb_short([draft(0, 100_000), draft(100_000, 130_000), draft(130_000, 230_000)], 60_000)
    assert [(d["start_ms"], d["end_ms"]) for d in out] == [(0, 130_000), (130_000, 230_000)]


def test_short_first_draft_joins_next():
    out = chapters.absorb_short([draft(0, 30_000), draft(30_000, 300_000)], 60_000)
    assert [(d["start_ms"], d["end_ms"], d["title"]) for d in out] == [(0, 300_000, "0")]


def test_merge_rule_limits():
    single = lambda s, e, name: draft(s, e, "SINGLE", [[name]])
    assert chapters.can_merge(single(0, 1, "a"), single(1, 2, "b"))
    assert not chapters.can_merge(single(0, 1, "a"), single(1, 2, "a"))
    assert not chapters.can_merge(draft(0, 1, "COMPARISON", [["a"], ["b"]]), single(1, 2, "c"))
    assert chapters.can_merge(draft(0, 1, "COMPARISON", [["a"], ["b"]]), draft(1, 2))
    assert not chapters.can_merge(draft(0, 200_000), draft(200_000, 300_001))


def test_reduce_count_matches_restart():
    rng = random.Random(31)
    for _ in range(200):
        at, drafts = 0, []
        for i in range(rng.randint(1, 12)):
            end = at + rng.randint(20_000, 200_000)
            mode, anchors = rng.choice([("NONE", []), ("SINGLE", [[f"a{i}"]]), ("COMPARISON", [[f"a{i}"], [f"b{i}"]])])
            drafts.append(draft(at, end, mode, anchors))
            at = end
        maximum = rng.randint(1, 8)
        want = list(drafts)
        while len(want) > maximum:
            spot = next((i for i in range(len(want) - 1) if chapters.can_merge(want[i], want[i + 1])), None)
            if spot is None:
                break
            want[spot:spot + 2] = [chapters.join_drafts(want[spot], want[spot + 1])]
        assert chapters.reduce_count(drafts, maximum) == want


def test_runs_beyond_the_limits_come_out(spark):
    """20,001 short turns in one run: nothing is dropped, every segment names the rule, and all turns are referenced once."""
    n = 20_001
    evidence = spark.range(n).select(
        F.lit(1).cast("bigint").alias("run_id"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("evidence_id"),
        (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), F.lit("word").alias("text"), F.lit("ASR_SEGMENT").alias("evidence_type"),
    ).unionByName(spark.createDataFrame([(2, "x", 0, 900, "word", "ASR_SEGMENT")], EVIDENCE))
    runs = evidence.groupBy("run_id").agg((F.max("end_ms") + 100).alias("duration_ms"))
    ends = evidence.select("run_id", F.col("end_ms").alias("timestamp_ms"))
    segments = segmentation.build_segments(runs, evidence, segmentation.boundary_candidates(runs, None, ends, None))
    totals = {r.run_id: r for r in segments.groupBy("run_id").agg(
        F.sum(F.size("evidence_refs")).alias("refs"), F.collect_set("reason").alias("reasons"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).collect()}
    assert totals[1].refs == n and totals[1].reasons == ["TOO_MANY_ITEMS"] and totals[1].ms == n * 1000
    assert totals[2].reasons == [""]
    tiles = evidence.select("run_id", "start_ms", (F.col("start_ms") + 1000).alias("end_ms"))
    grouped = chapters.group_near_target(tiles, 60_000)
    assert grouped.count() == n + 1 and grouped.where("start_ms - group_start >= 60000").count() == 0
    assert {r.run_id: r.minimum_chapters for r in chapters.minimum_chapters(tiles).collect()} == {1: 67, 2: 1}


def test_long_documents_are_rendered(spark):
    from spanledger.operators import compose

    n = 241
    rows = spark.range(1, n + 1).select(
        F.lit(1).alias("run_id"), F.col("id").alias("chapter_index"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 1000).alias("end_ms"),
        F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit("").alias("summary"), F.lit("GROUNDED").alias("content_status"))
    body = rows.select("run_id", "chapter_index", F.lit(0).alias("chunk"), F.lit("body").alias("text"))
    titles = spark.createDataFrame([(1, "T", "")], "run_id int, title string, overview string")
    none = spark.createDataFrame([], "run_id int, chapter_index bigint, pos int, text string")
    content = compose.render_documents(titles, rows, body, none).first().content
    assert content.count("\n## 第") == n and "## 第二百四十一章：t241\n" in content and content.index("第二百四十章：t240\n") < content.index("第二百四十一章：t241\n")
