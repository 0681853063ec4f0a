"""Sliced scans against plain loops, with one run holding most rows."""

import random

from pyspark.sql import functions as F

from spanledger.operators import spans
from spanledger.operators.scan import Scan, follow_jumps, ordered_fold, ordered_scan, time_bucket


def rows_of(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        start = rng.randint(0, 4000)
        rows.append((run, i, start, start + rng.randint(1, 60), rng.choice(["a", "b"]), rng.random()))
    return rows


SCHEMA = "run_id bigint, event_id bigint, start_ms bigint, end_ms bigint, text string, confidence double"


def by_run(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_ordered_scan_matches_loop(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    scans = [
        Scan("mx", "max_before", "end_ms"), Scan("sm", "sum_before", "end_ms"), Scan("ct", "count_before"), Scan("mn", "min_after", "end_ms"),
        Scan("lg", "lag", "text"), Scan("ld", "lead", "event_id"),
    ]
    got = {r.event_id: r for r in ordered_scan(df, ["run_id"], ["start_ms", "end_ms", "event_id"], time_bucket("start_ms", 250), scans).collect()}
    assert len(got) == len(rows)
    for run in by_run(rows).values():
        for i, row in enumerate(run):
            before, after = run[:i], run[i + 1:]
            out = got[row[1]]
            assert out.mx == max((r[3] for r in before), default=None)
            assert out.sm == (sum(r[3] for r in before) if before else None)
            assert out.ct == len(before)
            assert out.mn == min((r[3] for r in after), default=None)
            assert out.lg == (before[-1][4] if before else None)
            assert out.ld == (after[0][1] if after else None)


def merged(run, gap):
    out = []
    for _, _, start, end, _, confidence in run:
        if out and start - out[-1][1] <= gap:
            s, e, c, n = out[-1]
            out[-1] = (s, max(e, end), (c * (e - s) + confidence * (end - start)) / ((e - s) + (end - start)), n + 1)
        else:
            out.append((start, end, confidence, 1))
    return out


def test_merge_spans_matches_loop(spark):
    for seed, gap in ((2, 0), (3, 7), (4, 40)):
        rows = rows_of(seed)
        got = spans.merge_spans(spark.createDataFrame(rows, SCHEMA), ["run_id"], gap, ["event_id"], slice_ms=97)
        want = [(run, *m) for run, rs in by_run(rows).items() for m in merged(rs, gap)]
        have = sorted((r.run_id, r.start_ms, r.end_ms, r.confidence, r.n_spans) for r in got.collect())
        assert [h[:3] + h[4:] for h in have] == [w[:3] + w[4:] for w in sorted(want)]
        assert all(abs(h[3] - w[3]) < 1e-9 for h, w in zip(have, sorted(want)))


def test_gap_is_inclusive(spark):
    rows = [(1, 1, 0, 100, "a", 0.5), (1, 2, 300, 400, "a", 0.5), (1, 3, 601, 700, "a", 0.5)]
    got = spans.merge_spans(spark.createDataFrame(rows, SCHEMA), ["run_id"], 200, ["event_id"])
    assert sorted((r.start_ms, r.end_ms) for r in got.collect()) == [(0, 400), (601, 700)]


def test_duplicates_match_loop(spark):
    rng = random.Random(5)
    rows = []
    for run in (1, 2):
        at = 0
        for i in range(150):
            end = at + rng.choice([5, 10])
            rows.append((run, run * 1000 + i, at, end, rng.choice("aab"), rng.choice([0.1, 0.2, 0.3])))
            at = end if rng.random() < 0.8 else end + 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("evidence_id", F.format_string("%05d", "event_id"))
    got = {r.event_id for r in spans.remove_adjacent_duplicates(df, ["run_id"], "text", slice_ms=37).collect()}
    want = set()
    for run in by_run(rows).values():
        kept = []
        for row in run:
            if kept and kept[-1][3] == row[2] and kept[-1][4] == row[4]:
                if row[5] > kept[-1][5]:
                    kept[-1] = row
            else:
                kept.append(row)
        want |= {k[1] for k in kept}
    assert got == want


def test_silence_and_nearest(spark):
    rows = rows_of(6, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    runs = df.groupBy("run_id").agg(F.lit(5000).cast("bigint").alias("duration_ms"))
    got = sorted((r.run_id, r.start_ms, r.end_ms) for r in spans.silence(df, runs, ["run_id"], ["event_id"], slice_ms=333).collect())
    want = []
    for run, rs in by_run(rows).items():
        cursor = 0
        for r in rs:
            if r[2] > cursor:
                want.append((run, cursor, r[2]))
            cursor = max(cursor, r[3])
        if cursor < 5000:
            want.append((run, cursor, 5000))
    assert got == sorted(want)
    asked = df.select("run_id", F.col("start_ms").alias("timestamp_ms"))
    given = df.select("run_id", F.col("end_ms").alias("timestamp_ms"))
    near = {(r.run_id, r.timestamp_ms): r.nearest_ms for r in spans.nearest_points(asked, given, ["run_id"], 50, slice_ms=100).collect()}
    for run, rs in by_run(rows).items():
        for r in rs:
            best = min(((abs(x[3] - r[2]), x[3]) for x in rs if abs(x[3] - r[2]) <= 50), default=None)
            assert near.get((run, r[2])) == (best[1] if best else None)


def test_ordered_fold_walks_a_long_key(spark):
    """A key over many Arrow batches, and short ones, give what a loop gives."""
    rows = [(1, n, n * 7 % 13) for n in range(25_000)] + [(k, n, n % 5) for k in range(2, 60) for n in range(k % 4)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "k int, n int, v int")

    def step(state, v):
        total = 0 if state[0] > 40 else state[0] + v
        return (total,), total

    got = sorted((r.k, r.n, r.out) for r in ordered_fold(df, ["k"], ["n"], ["v"], "out", lambda: (0,), step).collect())
    want, state, key = [], (0,), None
    for k, n, v in sorted(rows):
        state = (0,) if k != key else state
        key = k
        state, value = step(state, v)
        want.append((k, n, value))
    assert got == want


def test_follow_jumps_marks_what_a_walk_meets(spark):
    """A dominating key, jumps within and across slices, gaps of empty slices, walks that end early, a single row, and ends that point nowhere."""
    rng = random.Random(9)
    rows = []
    for key, size in ((1, 6000), (2, 40), (3, 1), (None, 30)):
        at = sorted(rng.sample(range(size * 12), size))
        for i, place in enumerate(at):
            step = rng.choice([1, 1, 2, 3, 40])
            to = at[i + step] if i + step < size else rng.choice([None, size * 20, place])
            rows.append((key, place, None if key == 2 and i > 30 else to, f"r{place}"))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k int, a bigint, b bigint, other string")
    want, walk = [], {}
    for key, place, to, other in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        head, following = walk.get(key, (place, place))
        if place == following:
            head, following = place, to
        walk[key] = (head, following)
        want.append((key, place, to, other, head))
    known = [w for w in want if w[0] is not None]
    for width in (15, 1000):
        got = follow_jumps(df.where("k IS NOT NULL"), ["k"], "a", "b", F.floor(F.col("a") / width), "h")
        assert got.columns == ["k", "a", "b", "other", "h"]
        assert sorted(tuple(r) for r in got.collect()) == known
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("__slice" in line for line in plan.split("\n") if "REPARTITION_BY_COL" in line)  # rows move by key and slice
