"""Hand-calculable metric values and brute-force checks of the matchers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.functions import payload, text
from spanledger.operators import matching, quality, selection


def test_text_error_rates(spark):
    df = spark.createDataFrame([("abXd", "abcd", "one x", "one two"), ("ＡＢ  c", "ab c", "", "")], "h string, r string, hw string, rw string")
    ce, cu = quality.character_counts(F.col("h"), F.col("r"))
    we, wu = quality.word_counts(F.col("hw"), F.col("rw"))
    rows = df.select(quality.rate(ce, cu).alias("cer"), quality.rate(we, wu).alias("wer")).collect()
    assert [(r.cer, r.wer) for r in rows] == [(0.25, 0.5), (0.0, 0.0)]


def test_exact_characters_keep_case_and_space(spark):
    df = spark.createDataFrame([("A b", "a b")], "h string, r string")
    e, u = quality.exact_character_counts(F.col("h"), F.col("r"))
    assert df.select(e.alias("e"), u.alias("u")).collect()[0] == (1, 3)


def test_token_distance_against_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 8))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 8))]
        grid = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            grid[i][j] = min(grid[i - 1][j] + 1, grid[i][j - 1] + 1, grid[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert quality.token_distance(a, b) == grid[-1][-1]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 11)] + [(2, 5.0)], "k int, v double")
    got = {r.k: r.quantile_value for r in selection.nearest_rank(df, ["k"], "v", 0.9, F.floor("v")).collect()}
    assert got == {1: 9.0, 2: 5.0}


def test_best_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(150):
        weights = rng.integers(0, 9, size=(rng.integers(1, 6), rng.integers(1, 6)))
        wide = weights if weights.shape[0] <= weights.shape[1] else weights.T
        best = max(sum(wide[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert matching.best_assignment(weights) == best


def test_match_points_is_maximum():
    rng = random.Random(4)
    for _ in range(200):
        left = [rng.randint(0, 12) for _ in range(rng.randint(0, 5))]
        right = [rng.randint(0, 12) for _ in range(rng.randint(0, 5))]
        tolerance = rng.randint(0, 3)
        times = sorted(set(left + right))
        got = matching.match_points(times, [left.count(t) for t in times], [right.count(t) for t in times], tolerance)
        near = np.array([[int(abs(a - b) <= tolerance) for b in right] for a in left]).reshape(len(left), len(right))
        assert got == (matching.best_assignment(near) if near.size else 0)


def _frames(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_interval_metrics(spark):
    schema = "run_id bigint, start_ms bigint, end_ms bigint"
    reference = _frames(spark, [(1, 0, 100), (1, 100, 200), (2, 0, 50)], schema)
    hypothesis = _frames(spark, [(1, 0, 100), (3, 0, 9)], schema)
    rates = {r.run_id: r.error_rate for r in matching.interval_error(reference, hypothesis, ["run_id"]).collect()}
    assert rates == {1: 0.5, 2: 1.0, 3: 1.0}
    counts = {r.run_id: (r.matches, r.predicted, r.reference) for r in matching.interval_counts(reference, hypothesis, ["run_id"], 5).collect()}
    assert counts == {1: (1, 1, 2), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_interval_islands_change_nothing(spark):
    rng = random.Random(9)
    make = lambda n: [(1, s, s + rng.randint(1, 40)) for s in (rng.randint(0, 900) for _ in range(n))]
    left, right = make(40), make(40)
    schema = "run_id bigint, start_ms bigint, end_ms bigint"
    a, b = _frames(spark, left, schema), _frames(spark, right, schema)
    overlap = np.array([[max(0, min(x[2], y[2]) - max(x[1], y[1])) for y in right] for x in left])
    got = matching.interval_error(a, b, ["run_id"], slice_ms=111).collect()[0]
    assert got.matched_ms == matching.best_assignment(overlap)
    close = np.array([[int(abs(x[1] - y[1]) <= 8 and abs(x[2] - y[2]) <= 8) for y in right] for x in left])
    assert matching.interval_counts(a, b, ["run_id"], 8, slice_ms=111).collect()[0].matches == matching.best_assignment(close)


def test_boundary_f1_value(spark):
    schema = "run_id bigint, timestamp_ms bigint"
    out = matching.boundary_counts(_frames(spark, [(1, 0), (1, 1000), (1, 5000)], schema), _frames(spark, [(1, 100), (1, 9000)], schema), ["run_id"], 200)
    f1 = out.select(matching.f1(F.col("matches"), F.col("predicted"), F.col("reference")).alias("f")).collect()[0].f
    assert f1 == pytest.approx(0.4)


def test_report_statuses(spark):
    rows = spark.createDataFrame([("rtf", 3.0), ("zh_cer", 0.16), ("nonsense", 1.0)], "metric string, value double")
    got = {r.metric: r.status for r in quality.evaluate_thresholds(rows).collect()}
    assert (got["rtf"], got["zh_cer"], got["nonsense"], got["en_wer"]) == ("PASS", "FAIL", "UNKNOWN_METRIC", "NOT_RUN")


@pytest.mark.parametrize("text,want", [
    ('{"a": 1}', '{"a":1}'), ("```json\n[1, 2]\n```", "[1,2]"), ("<think>{\"x\":1}</think> ok {\"b\": \"}\"} bye", '{"b":"}"}'),
    ('{"a": NaN, "b": [1]}', None), ("no json", None), ('say [1, {"k": 2}] and {"z": 3}', '[1,{"k":2}]'), ("bad [1} then {\"c\": 1}", '{"c":1}'),
    ('{"a": "line\nbreak"}', '{"a":"line\\nbreak"}'), ("", None),
])
def test_json_recovery(spark, text, want):
    assert payload.recover(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(payload.recover_json(F.col("t")).alias("r")).collect()[0].r == want


@pytest.mark.parametrize("body,want", [
    ('{"choices":[{"message":{"content":" hi "}}]}', "hi"), ('{"content":[{"type":"reasoning","text":"no"},{"text":"yes"},"too"]}', "yes\ntoo"),
    ('{"output":[{"content":[{"text":"deep"}]}]}', "deep"), ('{"choices":[{"text":"t"}]}', "t"), ("[]", ""), ('{"choices":[]}', ""),
])
def test_message_text(spark, body, want):
    assert payload.message_text(body) == want
    assert spark.createDataFrame([(body,)], "t string").select(payload.response_text(F.col("t")).alias("r")).collect()[0].r == want


def test_claims_without_references_stay_open(spark):
    claims = spark.createDataFrame([(1,), (2,)], "claim_id int")
    refs, known = spark.createDataFrame([(1, "a")], "claim_id int, ref string"), spark.createDataFrame([("a",)], "ref string")
    assert quality.closure_rate(claims, refs, known).first().rate == 0.5
    assert quality.closure_rate(claims.limit(0), refs.limit(0), known).first().rate == 1.0
    missing = spark.createDataFrame([(True,), (False,)], "has_result boolean")
    assert quality.closure_rate(claims, refs, known, missing).first().rate == 0.0
    assert quality.closure_rate(claims, refs, known, missing.limit(0)).first().rate == 0.0


def test_visual_accuracy_without_units(spark):
    cases = spark.createDataFrame([(0, 0, 0, 0, True)], "units int, errors int, fields int, hits int, succeeded boolean")
    row = quality.visual_accuracy(cases).first()
    assert (row.visual_text_accuracy, row.visual_key_field_recall, row.text_reason, row.key_reason) == (None, None, "NO_REFERENCE_TEXT", "NO_KEY_FIELDS")
    assert quality.visual_accuracy(cases.limit(0)).first().text_reason == "CASES_NOT_READY"


def test_unplanned_results_are_refused(spark):
    planned = spark.createDataFrame([("r", 1), ("s", 1), ("u", 1)], "report string, case_id int")
    results = spark.createDataFrame([("r", 1, "SUCCEEDED"), ("r", 9, "SUCCEEDED"), ("s", 1, "SUCCEEDED"), ("u", 1, "FAIL"), ("u", 1, "SUCCEEDED")], "report string, case_id int, case_status string")
    got = {r.report: r.status for r in quality.report_status(planned, results, ["report"]).collect()}
    assert got == {"r": "REFUSED", "s": "SUCCEEDED", "u": "REFUSED"}


def test_required_targets_are_reported(spark):
    frames = spark.createDataFrame([(1, 1, 10, 5, [1]), (1, 2, 11, 5, [1]), (1, 3, 12, 5, [2]), (2, 1, 20, 5, [1]), (3, 1, 30, 500, [1])], "k int, ord int, frame_id int, size_bytes long, target_ids array<int>")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 7), (3, 1), (4, 1)], "k int, target_id int")
    got = {r.k: (r.frame_ids, r.reason) for r in selection.trim_frames(frames, targets, ["k"], 2, 100, 100).collect()}
    assert got == {1: ([10, 12], ""), 2: ([20], "TARGET_NOT_COVERED"), 3: (None, "NO_ADMITTED_FRAME"), 4: (None, "NO_ADMITTED_FRAME")}


def test_markers_go_in_one_pass(spark):
    row = spark.createDataFrame([("asr[asr_abc]_xyz",)], "t string").select(text.clean_markers(F.col("t")).alias("c")).first()
    assert row.c == "asr_xyz"


def test_conflicts_judge_by_the_earliest_request(spark, tmp_path):
    """25,000 requests of one key, latest first, in several batches: only the first batch's earliest is NEW."""
    from spanledger.streaming import evidence

    rows = spark.range(25_000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id")).alias("ts"), F.col("id").alias("request_id"), F.lit("s").alias("scope"), F.lit("k").alias("key"),
        F.when(F.col("id") == 24_999, "first").otherwise("other").alias("payload"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "part=0"))
    later = spark.createDataFrame([(30_000, "first"), (30_001, "other")], "request_id bigint, payload string")
    later.select(F.timestamp_seconds(F.lit(0)).alias("ts"), "request_id", F.lit("s").alias("scope"), F.lit("k").alias("key"), "payload").coalesce(1).write.parquet(str(tmp_path / "in" / "part=1"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    got = {r.request_id: r.outcome for r in evidence.flag_conflicts(stream).collect()}
    assert len(got) == 25_002 and got[24_999] == "NEW" and got[0] == "CONFLICT" and got[30_000] == "REUSED" and got[30_001] == "CONFLICT"
    assert sum(o == "NEW" for o in got.values()) == 1


def test_islands_of_two_hundred_thousand_intervals():
    rng = random.Random(6)
    starts = sorted(rng.randrange(1_000_000) for _ in range(100_000))
    reference = [(s, s + rng.randrange(1, 40)) for s in starts]
    hypothesis = [(max(0, s + rng.randrange(-8, 9)), e + rng.randrange(9)) for s, e in reference]
    hypothesis.sort()
    edges = matching.overlap_edges(reference, hypothesis)
    assert matching.heaviest_matching(edges, len(hypothesis)) > 0.6 * sum(e - s for s, e in reference)
    near = matching.close_edges(reference, hypothesis, 9)
    assert matching.heaviest_matching(near, len(hypothesis)) > 99_000


def test_sparse_edges_equal_all_pairs():
    rng = random.Random(7)
    for _ in range(100):
        sides = [sorted((s, s + rng.randrange(12)) for s in (rng.randrange(30) for _ in range(rng.randrange(1, 9)))) for _ in range(2)]
        overlap = [[(j, max(0, min(a[1], b[1]) - max(a[0], b[0]))) for j, b in enumerate(sides[1])] for a in sides[0]]
        assert [sorted(e) for e in matching.overlap_edges(*sides)] == [[(j, w) for j, w in row if w] for row in overlap]
        close = [[(j, 1) for j, b in enumerate(sides[1]) if abs(a[0] - b[0]) <= 4 and abs(a[1] - b[1]) <= 4] for a in sides[0]]
        assert matching.close_edges(*sides, 4) == close


def plain_recover(text):
    """First value that decodes from any bracket on, tried one after the other."""
    import json

    decoder = json.JSONDecoder(strict=False, parse_constant=payload._refuse)
    for at, c in enumerate(text):
        if c in "[{":
            try:
                return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def test_embedded_json_equals_trying_every_bracket():
    rng = random.Random(12)
    parts = ["[", "]", "{", "}", '"', ",", ":", '"a"', '"[1]"', "1", "-0.5e3", "01", "true", "nul", "NaN", " ", "\n", "\\", '\\"', '{"k":1}', "[]", "é"]
    for _ in range(6000):
        text = "x " + "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        shown = text.strip()
        assert payload.recover(text) == plain_recover(shown), text  # a text that starts with a bracket is not searched


@pytest.mark.parametrize("text", ["[" * 200_000, "x " + "[" * 200_000, "x " + '{"a":' * 100_000, "x " + '["' * 100_000, "x " + "[" * 100_000 + "]" * 100_000, "x " + '[{"' * 60_000])
def test_deep_nesting_gives_null_in_linear_time(text):
    import time

    started = time.process_time()
    assert payload.recover(text) is None
    assert payload.message_text(text) == ""
    assert payload._without(text, frozenset(["a"])) is None
    assert time.process_time() - started < 5


def test_deep_content_is_read():
    body = '{"content":' * 3000 + '"told"' + "}" * 3000
    assert payload.message_text(body) in ("told", "")
    tree = "told"
    for _ in range(50_000):
        tree = {"content": [tree]}
    assert list(payload._shown(tree)) == ["told"]
    while isinstance(tree, dict):
        tree = tree["content"][0]


def test_retired_fields_at_any_depth(spark):
    rows = [('{"sections":1,"a":{"key_points":[],"b":[{"sections":{"x":1},"y":"sections"}]}}',), ("[1,2]",), ("nothing",), (None,), ('{"\\u0073ections":1,"é":2}',), ("[" * 2000 + '"sections"' + "]" * 2000,)]
    got = [r.d for r in spark.createDataFrame(rows, "t string").select(payload.drop_fields(F.col("t")).alias("d")).collect()]
    assert got[:5] == ['{"a":{"b":[{"y":"sections"}]}}', "[1,2]", None, None, '{"é":2}']


def test_boundary_matching_in_one_pass_is_maximum():
    from collections import deque

    rng = random.Random(14)
    for _ in range(3000):
        times = sorted(rng.sample(range(20), rng.randrange(1, 8)))
        left, right = [rng.randrange(3) for _ in times], [rng.randrange(3) for _ in times]
        step, state, total = matching._point_step(3), (0, deque()), 0
        for at, a, b in zip(times, left, right, strict=True):
            state, matched = step(state, at, a, b)
            total += matched
        assert total == matching.match_points(times, left, right, 3)


def test_a_chain_of_two_hundred_thousand_rows(spark):
    from spanledger.operators import spans

    n = 200_000
    rows = spark.range(n).select(
        F.lit(1).alias("run_id"), F.lpad(F.col("id").cast("string"), 7, "0").alias("evidence_id"), F.lit("same").alias("norm"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 100).alias("end_ms"),
        (F.col("id") % 2).cast("double").alias("confidence"))
    got = spans.remove_adjacent_duplicates(rows, ["run_id"], "norm")
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    kept, low, high = got.agg(F.count("*"), F.min("start_ms"), F.max("start_ms")).first()
    # the first row gives way to its more confident follower, which holds until the row after next touches nothing
    assert (kept, low) == (n // 2, 100) and high >= n * 100 - 200
