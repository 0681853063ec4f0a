"""Whitening against exact arithmetic and numpy."""

import math
import random
from fractions import Fraction

import numpy as np

from spanledger.llm import whitening

FIELDS = "vec_id bigint, embedding array<float>, x int, w string, n int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], FIELDS)


def check(spark, rows, size):
    fit = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    n, s = len(fit), [sum(v[k] for _, v in fit) for k in range(size)]
    exact = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for _, v in fit), n**3) for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(exact[i][i] for i in range(size)))
    got = whitening.whitened_vectors(frame(spark, rows)).collect()
    assert len(got) == n * min(8, size)
    want = sorted((i, sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True))) for i, v in fit)
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == [(i, d if d < 2**63 else None) for i, d in want]
    found = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, v in fit:
        centred = np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s, strict=True)])
        for k in range(min(8, size)):
            r = found[i, k + 1]
            assert r["n"] == n and abs(r["explained"] - values[k] / trace) <= 1e-9 and r["identity_error"] <= 1e-9
            if values[k] > 1e-12 * trace:
                w = float(centred @ vectors[:, k] / math.sqrt(values[k]))
                sign = signs.setdefault(k, 1 if w * r["whitened"] >= 0 else -1) if abs(w) > 1e-3 else signs.get(k, math.copysign(1, w * r["whitened"]))
                assert abs(w - sign * r["whitened"]) < 1e-6, (k, w, r["whitened"])
            else:
                assert r["whitened"] is None


def test_whitened_rows_equal_exact_covariances(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in rng.normal(size=12) @ mixing + 7]) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 12), (1002, [1.0] * 11 + [None]), (1003, [float("inf")] + [0.0] * 11), (1004, []), (1005, [1.0, 2.0])]
    check(spark, rows, 12)


def test_wide_values_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([3, 9, 13]), rng.uniform(-1, 1) * 1e12, rng.random()]) for i in range(50)]
    check(spark, rows, 3)


def test_pair_squares_in_longs_and_beyond():
    rng = np.random.default_rng(1)
    for scale in (100, 2**45):
        y = rng.integers(-scale, scale, (200, 5))
        totals = np.zeros((5, 5), dtype=object)
        whitening.pair_squares(y, totals)
        for i in range(5):
            for j in range(i, 5):
                assert totals[i, j] == sum((int(r[i]) + int(r[j])) ** 2 if i < j else int(r[i]) ** 2 for r in y)


def test_no_variance_no_rows_and_repeats(spark):
    assert whitening.whitened_vectors(frame(spark, [])).count() == 0
    assert whitening.whitened_vectors(frame(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whitened_vectors(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(got) == 6 and all((r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (0, None, 0.0, 0.0) for r in got)
    got = whitening.whitened_vectors(frame(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 4.0]), (3, [1.0, 4.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["whitened"] and abs(round(r["whitened"], 9))) for r in got if r["component"] == 1) == [(0, 1, 1.0)] * 2 + [(3, 1, 1.0)] * 2
    assert all(r["whitened"] is None for r in got if r["component"] == 2)
