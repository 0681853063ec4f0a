"""One-to-one matching of boundaries and intervals.

A matching never crosses a stretch of time that no candidate pair bridges, so each
sample is first cut into such islands (a sliced scan, see :mod:`spans`) and equal
times are counted together before the shuffle. Only then is each island matched, in
Arrow batches.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spanledger.operators.scan import ordered_fold
from spanledger.operators.spans import SLICE_MS, interval_islands


def match_points(times: list[int], left: list[int], right: list[int], tolerance: int) -> int:
    """Largest one-to-one matching of two multisets of times within the tolerance."""
    left, right = list(left), list(right)
    matched = j = 0
    for i, at in enumerate(times):
        while left[i] and j < len(times):
            if times[j] < at - tolerance or not right[j]:
                j += 1
                continue
            if times[j] > at + tolerance:
                break
            pairs = min(left[i], right[j])
            matched += pairs
            left[i] -= pairs
            right[j] -= pairs
    return matched


def heaviest_matching(edges: list[list[tuple[int, int]]], columns: int) -> int:
    """Weight of the heaviest one-to-one matching of rows to columns over the given edges only.

    ``edges[row]`` lists (column, weight) with positive weights. Rows enter one at a time along a cheapest augmenting path; a row may
    also stay alone, on a column of its own without weight. A path search visits the neighbourhood it needs and
    prices change only there, so memory is linear in the edges and long islands of local edges take near-linear time.
    """
    row_price = [0] * len(edges)
    column_price = [0] * (columns + len(edges))
    owner = [-1] * (columns + len(edges))
    total = 0
    for start in range(len(edges)):
        row_price[start] = min([0, *(-w - column_price[c] for c, w in edges[start])])
        reached, via, rows, done = {}, {}, {start: 0}, {}
        heap: list[tuple[int, bool, int]] = []
        row, at = start, 0
        while True:
            alone = columns + row
            for column, weight in (*edges[row], (alone, 0)):
                if column not in done:
                    further = at - weight - row_price[row] - column_price[column]
                    if further < reached.get(column, further + 1):
                        reached[column], via[column] = further, row
                        heapq.heappush(heap, (further, owner[column] >= 0, column))
            while True:
                at, taken, column = heapq.heappop(heap)
                if column not in done and at == reached[column]:
                    break
            done[column] = at
            if not taken:
                break
            row = owner[column]
            rows[row] = at
        for row, distance in rows.items():
            row_price[row] += at - distance
        for other, distance in done.items():
            column_price[other] -= at - distance
        previous = {owner[c]: c for c in done if owner[c] >= 0}
        while True:
            row = via[column]
            owner[column] = row
            if row == start:
                break
            column = previous[row]
    held = {row: column for column, row in enumerate(owner) if row >= 0}
    for row, column in held.items():
        total += next((w for c, w in edges[row] if c == column), 0)
    return total


def best_assignment(weights: np.ndarray) -> int:
    """The same for a whole matrix of weights."""
    return heaviest_matching([[(int(j), int(row[j])) for j in np.flatnonzero(row)] for row in weights], weights.shape[1])


def overlap_edges(reference: list[tuple[int, int]], hypothesis: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For each reference interval the hypothesis intervals it overlaps and by how much, in one sweep over the starts."""
    edges: list[list[tuple[int, int]]] = [[] for _ in reference]
    open_sides: tuple[list[int], list[int]] = ([], [])
    sides = (reference, hypothesis)
    for start, side, index in sorted([(x[0], 0, i) for i, x in enumerate(reference)] + [(x[0], 1, i) for i, x in enumerate(hypothesis)]):
        other = sides[1 - side]
        open_sides[1 - side][:] = [i for i in open_sides[1 - side] if other[i][1] > start]
        end = sides[side][index][1]
        for i in open_sides[1 - side]:
            shared = min(end, other[i][1]) - start
            if shared > 0:
                edges[index if side == 0 else i].append((i if side == 0 else index, shared))
        open_sides[side].append(index)
    return edges


def close_edges(reference: list[tuple[int, int]], hypothesis: list[tuple[int, int]], tolerance: int) -> list[list[tuple[int, int]]]:
    """For each reference interval the hypothesis intervals whose two ends both lie within the tolerance; ``hypothesis`` is in order of starts."""
    starts = [s for s, _ in hypothesis]
    return [
        [(j, 1) for j in range(bisect_left(starts, s - tolerance), bisect_right(starts, s + tolerance)) if abs(hypothesis[j][1] - e) <= tolerance]
        for s, e in reference
    ]


def _point_step(tolerance: int):
    """Fold over times in order: points take the oldest open points of the other side that are still near enough, then those of their own time.

    Only one side is open at a time, and only what lies within the tolerance is kept.
    """
    def step(state: tuple, at: int, left: int, right: int) -> tuple:
        side, open_ = state
        while open_ and open_[0][0] < at - tolerance:
            open_.popleft()
        arriving, matched = [left, right], 0
        while open_ and arriving[1 - side]:
            pairs = min(arriving[1 - side], open_[0][1])
            matched += pairs
            arriving[1 - side] -= pairs
            open_[0][1] -= pairs
            if not open_[0][1]:
                open_.popleft()
        both = min(arriving)
        rest = max(arriving) - both
        if rest:
            side = arriving.index(max(arriving))
            open_.append([at, rest])
        return (side, open_), matched + both

    return step


def boundary_counts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], tolerance_ms: int, slice_ms: int = SLICE_MS) -> DataFrame:
    """Matches, predicted and reference counts per sample."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = reference.select(*keys, "timestamp_ms", one.alias("r"), none.alias("h")).unionByName(
        hypothesis.select(*keys, "timestamp_ms", none.alias("r"), one.alias("h")))
    points = both.groupBy(*keys, "timestamp_ms").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    spans = points.select(*keys, F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"), "r", "h")
    isles = interval_islands(spans, keys, tolerance_ms, ["start_ms"], slice_ms)
    walked = ordered_fold(isles, [*keys, "island"], ["start_ms"], ["start_ms", "r", "h"], "__m", lambda: (0, deque()), _point_step(tolerance_ms))
    return walked.groupBy(*keys).agg(F.sum("__m").alias("matches"), F.sum("h").alias("predicted"), F.sum("r").alias("reference"))


def _intervals(rows) -> list[tuple[int, int]]:
    return [(r["start_ms"], r["end_ms"]) for r in rows]


def _island_weight(edges_of):
    @F.pandas_udf(LongType())
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([heaviest_matching(edges_of(_intervals(a), _intervals(b)), len(b)) for a, b in zip(reference, hypothesis)], dtype="int64")

    return run


def _interval_islands(reference: DataFrame, hypothesis: DataFrame, keys: list[str], by_start: bool, gap_ms: int, slice_ms: int) -> DataFrame:
    def side(frame: DataFrame, name: int) -> DataFrame:
        return frame.select(*keys, "start_ms", "end_ms", F.lit(name).alias("side"), F.struct("start_ms", "end_ms").alias("iv"))

    both = side(reference, 0).unionByName(side(hypothesis, 1))
    if by_start:
        both = both.withColumn("end_ms", F.col("start_ms"))
    isles = interval_islands(both, keys, gap_ms, ["start_ms", "end_ms", "side"], slice_ms)
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("iv"))))
    return isles.groupBy(*keys, "island").agg(pick(0).alias("ref"), pick(1).alias("hyp"))


def interval_counts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], tolerance_ms: int, slice_ms: int = SLICE_MS) -> DataFrame:
    """Largest one-to-one matching with both ends within the tolerance."""
    lists = _interval_islands(reference, hypothesis, keys, True, tolerance_ms, slice_ms)
    matched = lists.where((F.size("ref") > 0) & (F.size("hyp") > 0)).select(*keys, _island_weight(lambda a, b: close_edges(a, b, tolerance_ms))("ref", "hyp").alias("m"))
    sizes = lists.groupBy(*keys).agg(F.sum(F.size("hyp")).alias("predicted"), F.sum(F.size("ref")).alias("reference"))
    return sizes.join(matched.groupBy(*keys).agg(F.sum("m").alias("m")), keys, "left").select(
        *keys, F.coalesce("m", F.lit(0)).cast("bigint").alias("matches"), "predicted", "reference")


def interval_error(reference: DataFrame, hypothesis: DataFrame, keys: list[str], slice_ms: int = SLICE_MS) -> DataFrame:
    """One minus the best one-to-one overlap over the reference duration."""
    lists = _interval_islands(reference, hypothesis, keys, False, -1, slice_ms)
    weight = lists.where((F.size("ref") > 0) & (F.size("hyp") > 0)).select(*keys, _island_weight(overlap_edges)("ref", "hyp").alias("w"))
    length = lambda side: F.aggregate(side, F.lit(0).cast("bigint"), lambda acc, x: acc + x["end_ms"] - x["start_ms"])
    totals = lists.groupBy(*keys).agg(F.sum(length("ref")).alias("reference_ms"), F.sum(F.size("hyp")).alias("__h"))
    joined = totals.join(weight.groupBy(*keys).agg(F.sum("w").alias("__w")), keys, "left")
    matched = F.coalesce("__w", F.lit(0)).cast("bigint")
    rate = F.when(F.col("reference_ms") == 0, F.when(F.col("__h") == 0, 0.0).otherwise(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - matched / F.col("reference_ms")))
    return joined.select(*keys, matched.alias("matched_ms"), "reference_ms", rate.alias("error_rate"))


def f1(matches, predicted, reference):
    """F1 from counts: both sides empty 1.0, no match 0.0."""
    precision, recall = matches / predicted, matches / reference
    return (
        F.when((predicted == 0) & (reference == 0), 1.0).when(matches == 0, 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )
