"""Span algebra without a size bound per run: gap merge, silence, nearest points.

Every function cuts a run into time slices (see :mod:`scan`), so a run that holds
a large share of all rows is processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.scan import UNBOUNDED_AFTER, UNBOUNDED_BEFORE, Scan, ordered_scan, time_bucket

SLICE_MS = 6 * 3_600_000


def clamp_overrun(spans: DataFrame, duration_ms, tolerance_ms: int = 1) -> DataFrame:
    """Clamp ends that overrun the timeline by the tolerance, flag the rest."""
    limit = duration_ms if not isinstance(duration_ms, int) else F.lit(duration_ms)
    start, end = F.col("start_ms"), F.col("end_ms")
    reason = (
        F.when((start < 0) | (end <= start), "EMPTY_OR_NEGATIVE")
        .when(end > limit + tolerance_ms, "TIMELINE_OVERRUN")
        .when(F.least(end, limit) <= start, "EMPTY_OR_NEGATIVE")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "CONFIDENCE_RANGE")
    )
    return spans.withColumn("reject_reason", reason).withColumn("end_ms", F.least(end, limit))


def interval_islands(
    spans: DataFrame, keys: list[str], gap_ms: int, order: list[str], slice_ms: int = SLICE_MS,
    value: str | None = None,
) -> DataFrame:
    """Add ``island`` (the order key of its first row) and ``open_end``.

    A row opens an island when it starts more than ``gap_ms`` after every earlier
    end, or when ``value`` differs from the previous row. ``open_end`` is the largest
    earlier end (null on the first row of a run).

    Rows are shuffled once, by run and slice; only slice summaries travel further.
    A slice knows its own last opening. Whether an opening caused by a gap still
    stands depends only on the largest end carried in, and whether the first row
    opens depends only on the last value carried in, so one pass over the summaries
    settles both.
    """
    cell = [*keys, "__slice"]
    inside = Window.partitionBy(*cell).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row_key = F.struct(*order)
    seen = F.struct(F.lit(1) if value is None else F.col(value))

    def gap_after(end: Column) -> Column:
        return end.isNull() | (F.col("start_ms") - end > gap_ms)

    local = (
        spans.withColumn("__slice", time_bucket("start_ms", slice_ms))
        .withColumn("__end_before", F.max("end_ms").over(inside.rowsBetween(*UNBOUNDED_BEFORE)))
        .withColumn("__before", F.lag(seen).over(inside))
    )
    summary = local.groupBy(*cell).agg(
        F.max("end_ms").alias("__max_end"),
        F.max(F.when(gap_after(F.col("__end_before")), row_key)).alias("__gap_open"),
        F.max(F.when(F.col("__before") != seen, row_key)).alias("__value_open"),
        F.min(F.struct(row_key.alias("key"), seen.alias("v"))).alias("__first"),
        F.max(F.struct(row_key.alias("key"), seen.alias("v"))).alias("__last"),
    )
    across = Window.partitionBy(*keys).orderBy("__slice")
    earlier = across.rowsBetween(*UNBOUNDED_BEFORE)
    summary = summary.withColumn("__carry_end", F.max("__max_end").over(earlier)).withColumn(
        "__carry_value", F.lag("__last").over(across)["v"]
    )
    gap_stands = F.col("__carry_end").isNull() | (F.col("__gap_open.start_ms") - F.col("__carry_end") > gap_ms)
    first_opens = F.col("__carry_value") != F.col("__first.v")
    summary = summary.withColumn("__standing", F.greatest(
        F.when(gap_stands, F.col("__gap_open")), F.col("__value_open"), F.when(first_opens, F.col("__first.key")),
    ))
    carry = summary.select(*cell, "__carry_end", "__carry_value", F.max("__standing").over(earlier).alias("__carry_open"))
    placed = local.join(carry, cell, "left").withColumn("open_end", F.greatest("__end_before", "__carry_end"))
    changed = F.coalesce("__before", "__carry_value") != seen
    opening = F.when(gap_after(F.col("open_end")) | F.coalesce(changed, F.lit(False)), row_key)
    island = F.coalesce(F.max(opening).over(upto), F.col("__carry_open"))
    return placed.select(*spans.columns, island.alias("island"), "open_end", "__slice")


def merge_spans(
    spans: DataFrame, keys: list[str], gap_ms: int, tiebreak: list[str], slice_ms: int = SLICE_MS
) -> DataFrame:
    """Merge spans closer than ``gap_ms`` (inclusive).

    The merged confidence weighs each new span against the extent merged so far:
    ``c <- (c * D + x * d) / (D + d)``. That is an affine map of ``c``, and affine
    maps compose, so each slice reduces its rows to one map and the maps of an
    island are composed in slice order. No island is collected.
    """
    order = ["start_ms", "end_ms", *tiebreak]
    rows = interval_islands(spans, keys, gap_ms, order, slice_ms).withColumn("__isle", F.col("island.start_ms"))
    length = (F.col("end_ms") - F.col("start_ms")).cast("double")
    first = F.struct(*order) == F.col("island")
    extent = (F.col("open_end") - F.col("__isle")).cast("double")
    rows = rows.withColumn("__ln", F.when(first, F.lit(0.0)).otherwise(F.log(extent / (extent + length))))
    rows = rows.withColumn(
        "__add",
        F.when(first, F.col("confidence")).otherwise(F.col("confidence") * length / (extent + length)),
    )
    cell = Window.partitionBy(*keys, "__slice", "__isle").orderBy(*order)
    later = F.coalesce(F.sum("__ln").over(cell.rowsBetween(*UNBOUNDED_AFTER)), F.lit(0.0))
    rows = rows.withColumn("__part", F.col("__add") * F.exp(later))
    slices = rows.groupBy(*keys, "__slice", "__isle").agg(
        F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"),
        F.sum("__part").alias("__b"), F.sum("__ln").alias("__a"),
    )
    tail = Window.partitionBy(*keys, "__isle").orderBy("__slice").rowsBetween(*UNBOUNDED_AFTER)
    slices = slices.withColumn("__rest", F.coalesce(F.sum("__a").over(tail), F.lit(0.0)))
    return slices.groupBy(*keys, F.col("__isle").alias("start_ms")).agg(
        F.max("end_ms").alias("end_ms"),
        F.sum(F.col("__b") * F.exp("__rest")).alias("confidence"),
        F.sum("n").alias("n_spans"),
    )


def silence(
    spans: DataFrame, runs: DataFrame, keys: list[str], tiebreak: list[str], slice_ms: int = SLICE_MS
) -> DataFrame:
    """Complement of the spans within ``[0, duration_ms)``."""
    order = ["start_ms", "end_ms", *tiebreak]
    rows = ordered_scan(
        spans.select(*keys, *order), keys, order, time_bucket("start_ms", slice_ms),
        [Scan("covered_to", "max_before", "end_ms")],
    )
    cursor = F.coalesce("covered_to", F.lit(0)).cast("bigint")
    gaps = rows.where(F.col("start_ms") > cursor).select(
        *keys, cursor.alias("start_ms"), F.col("start_ms").alias("end_ms")
    )
    last = spans.groupBy(*keys).agg(F.max("end_ms").alias("__covered"))
    tail = runs.select(*keys, "duration_ms").join(last, keys, "left").select(
        *keys, F.coalesce("__covered", F.lit(0)).cast("bigint").alias("start_ms"),
        F.col("duration_ms").alias("end_ms"),
    ).where(F.col("start_ms") < F.col("end_ms"))
    return gaps.unionByName(tail)


def long_silence_points(
    silences: DataFrame, runs: DataFrame, keys: list[str], minimum_ms: int = 1000
) -> DataFrame:
    """Edges of long silences that lie inside the timeline."""
    long = silences.where(F.col("end_ms") - F.col("start_ms") >= minimum_ms).join(
        runs.select(*keys, "duration_ms"), keys
    )
    points = F.explode(F.array(
        F.when(F.col("start_ms") > 0, F.col("start_ms")),
        F.when(F.col("end_ms") < F.col("duration_ms"), F.col("end_ms")),
    ))
    return long.select(*keys, points.alias("timestamp_ms")).where("timestamp_ms IS NOT NULL")


def change_points(
    rows: DataFrame, keys: list[str], order: list[str], column: str, bucket
) -> DataFrame:
    """Rows whose value differs from the previous row of the run."""
    scanned = ordered_scan(
        rows, keys, order, bucket, [Scan("previous", "lag", column), Scan("__seen", "count_before")]
    )
    return scanned.where((F.col("__seen") > 0) & ~F.col("previous").eqNullSafe(F.col(column))).drop("__seen")


def remove_adjacent_duplicates(
    segments: DataFrame, keys: list[str], normalized: str, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Drop a segment that repeats the last kept one and starts exactly at its end.

    The strictly more confident copy is kept. A row can only repeat a kept row of
    the same text whose end it touches, so the rows are cut into chains wherever
    the text changes or every earlier end lies before the start. Chains stream through in order; the last kept row is
    all that is remembered, and it leaves when a row follows that does not replace it.
    """
    order = ["start_ms", "end_ms", "evidence_id"]
    chained = interval_islands(segments, keys, 0, order, slice_ms, normalized)
    seen = [chained.columns.index(c) for c in (*keys, "island", "start_ms", "end_ms", "confidence")]

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last_end, last, held = None, None, None, None
        for batch in batches:
            leaving, place = [], None  # rows of this batch that stay, and the place of the last kept row if it is one of them
            for i, (*this, start, end, confidence) in enumerate(zip(*(batch.column(c).to_pylist() for c in seen), strict=True)):
                if this == chain and last_end == start:
                    if confidence is None or last is None or confidence <= last:
                        continue
                elif place is not None:
                    leaving.append(place)
                elif held is not None:
                    yield held
                chain, last_end, last, held, place = this, end, confidence, None, i
            yield batch.take(pa.array(leaving, pa.int64()))
            if place is not None:
                held = batch.slice(place, 1)
        if held is not None:
            yield held

    rows = chained.repartition(*keys, "island").sortWithinPartitions(*keys, "island", *order)
    return rows.mapInArrow(kept, chained.schema).select(*segments.columns)


def nearest_points(
    queries: DataFrame, points: DataFrame, keys: list[str], tolerance_ms: int, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Closest point within the tolerance for every query time; ties take the earlier.

    Both sides need ``timestamp_ms``. Only the neighbours on either side can be
    closest, so one ordered scan replaces a band join and emits no pairs.
    """
    asked = queries.select(*keys, "timestamp_ms").distinct().withColumn("__point", F.lit(None).cast("bigint"))
    given = points.select(*keys, "timestamp_ms").distinct().withColumn("__point", F.col("timestamp_ms"))
    both = asked.withColumn("__kind", F.lit(1)).unionByName(given.withColumn("__kind", F.lit(0)))
    scanned = ordered_scan(
        both, keys, ["timestamp_ms", "__kind"], time_bucket("timestamp_ms", slice_ms),
        [Scan("__left", "max_before", "__point"), Scan("__right", "min_after", "__point")],
    ).where("__kind = 1")
    left = F.col("timestamp_ms") - F.col("__left")
    right = F.col("__right") - F.col("timestamp_ms")
    best = F.when(F.col("__right").isNull() | (left <= right), F.col("__left")).otherwise(F.col("__right"))
    return (
        scanned.select(*keys, "timestamp_ms", best.alias("nearest_ms"))
        .withColumn("distance_ms", F.abs(F.col("nearest_ms") - F.col("timestamp_ms")))
        .where(F.col("distance_ms") <= tolerance_ms)
    )


def as_of_owner(rows: DataFrame, ranges: DataFrame, keys: list[str], slice_ms: int = SLICE_MS) -> DataFrame:
    """Add ``owner_start``: the start of the last range that begins at or before each row.

    For ranges that tile a timeline this is the covering range; callers compare
    the ends. A scan is used in place of a range join.
    """
    marks = ranges.select(*keys, F.col("start_ms").alias("__at")).withColumn("__mark", F.col("__at"))
    columns = [c for c in rows.columns if c not in keys]
    packed = rows.select(*keys, F.col("start_ms").alias("__at"), F.struct(*columns).alias("__row"))
    both = packed.withColumn("__kind", F.lit(1)).unionByName(
        marks.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    scanned = ordered_scan(
        both, keys, ["__at", "__kind"], time_bucket("__at", slice_ms), [Scan("owner_start", "max_before", "__mark")]
    ).where("__kind = 1")
    return scanned.select(*keys, "__row.*", "owner_start")


def contained_in(
    evidence: DataFrame, ranges: DataFrame, keys: list[str], slice_ms: int = 300_000
) -> DataFrame:
    """Evidence lying inside a range, by run and time slice.

    Each range is listed in every slice it touches and each evidence row only in
    the slice of its start, so the pairs found are exact and never repeated.
    Range columns get the prefix ``range_``.
    """
    last = F.floor((F.col("end_ms") - 1) / slice_ms).cast("bigint")
    cells = ranges.select(
        *keys,
        *[F.col(c).alias(f"range_{c}") for c in ranges.columns if c not in keys],
        F.explode(F.sequence(time_bucket("start_ms", slice_ms), last)).alias("__slice"),
    )
    return (
        evidence.withColumn("__slice", time_bucket("start_ms", slice_ms))
        .join(cells, [*keys, "__slice"])
        .where((F.col("range_start_ms") <= F.col("start_ms")) & (F.col("end_ms") <= F.col("range_end_ms")))
        .drop("__slice")
    )


def sliding_count(
    points: DataFrame, keys: list[str], span_ms: int, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Add ``n``: points of the run in ``[t - span, t]``.

    Slices are extended by one span, so every window lies inside one slice.
    """
    home = F.floor(F.col("timestamp_ms") / slice_ms).cast("bigint")
    after = F.floor((F.col("timestamp_ms") + span_ms) / slice_ms).cast("bigint")
    copies = points.withColumn("__home", home).withColumn("__cell", F.explode(F.sequence(home, after)))
    window = Window.partitionBy(*keys, "__cell").orderBy("timestamp_ms").rangeBetween(-span_ms, 0)
    return copies.withColumn("n", F.count(F.lit(1)).over(window)).where("__cell = __home").drop("__cell", "__home")


def densest_cluster(
    frames: DataFrame, keys: list[str], span_ms: int = 300_000, keep: int = 4, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Earliest largest set of frames within ``span_ms``, thinned to ``keep`` evenly spaced ones.

    ``frames`` needs ``frame_id`` and ``timestamp_ms``.
    """
    unique = frames.groupBy(*keys, "timestamp_ms").agg(F.min("frame_id").alias("frame_id"))
    counted = sliding_count(unique, keys, span_ms, slice_ms)
    best = counted.groupBy(*keys).agg(
        F.max(F.struct(F.col("n"), (-F.col("timestamp_ms")).alias("neg"))).alias("b")
    ).select(*keys, F.col("b.n").alias("n"), (-F.col("b.neg")).alias("last_ms"))
    members = unique.join(best, keys).where(
        F.col("timestamp_ms").between(F.col("last_ms") - span_ms, F.col("last_ms"))
    )
    position = ordered_scan(
        members, keys, ["timestamp_ms"], time_bucket("timestamp_ms", 10_000), [Scan("pos", "count_before")]
    )
    last = F.col("n") - 1
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(keep - 1)),
        lambda p: F.floor((last * p + (keep - 1) // 2) / (keep - 1)).cast("bigint"),
    )
    return position.where((F.col("n") <= keep) | F.array_contains(slots, F.col("pos"))).select(
        *keys, "frame_id", "timestamp_ms", "pos", F.col("n").alias("cluster_size")
    )


def project_windows(raw: DataFrame, language: str = "language") -> DataFrame:
    """Window-relative segments to absolute time with a per-row warning.

    Needs ``window_start_ms``, ``window_end_ms``, ``rel_start_ms``, ``rel_end_ms``
    and ``text``. Blank text is skipped; rows outside their window are kept with
    ``warning = 'ASR_TIMESTAMP_DROPPED'`` so that callers can count them.
    """
    width = F.col("window_end_ms") - F.col("window_start_ms")
    start = F.greatest(F.lit(0), F.col("rel_start_ms"))
    end = F.least(width, F.col("rel_end_ms"))
    warning = (
        F.when(end <= start, "ASR_TIMESTAMP_DROPPED")
        .when((start != F.col("rel_start_ms")) | (end != F.col("rel_end_ms")), "ASR_TIMESTAMP_CLAMPED")
        .otherwise("")
    )
    return (
        raw.withColumn("text", F.trim("text")).where(F.length("text") > 0)
        .withColumn("warning", warning)
        .withColumn("start_ms", (F.col("window_start_ms") + start).cast("bigint"))
        .withColumn("end_ms", (F.col("window_start_ms") + end).cast("bigint"))
    )
