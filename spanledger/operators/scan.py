"""Ordered scans over large keys without handing one key to one task.

A plain ``Window.partitionBy(run)`` sends every row of a run to one task. Here
each run is cut into buckets that follow the sort order (a time slice or a range
of sequence numbers). Every bucket is summarised with an ordinary partial
aggregation, the short list of summaries is scanned per run, and each bucket is
then scanned on its own starting from the state carried in. The result equals
the plain window; a run that holds a third of all rows is spread over as many
tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanledger.session import checkpoint

UNBOUNDED_BEFORE = (Window.unboundedPreceding, -1)
UNBOUNDED_AFTER = (1, Window.unboundedFollowing)


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`ordered_scan`.

    ``op`` is one of ``max_before``, ``min_before``, ``sum_before``,
    ``count_before``, ``min_after``, ``max_after``, ``lag`` and ``lead``. The
    current row is never part of its own result. ``lag`` and ``lead`` take the
    neighbouring row even when its value is null.
    """

    name: str
    op: str
    value: str | None = None


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, scans: list[Scan]
) -> DataFrame:
    """Add one column per scan, computed over ``keys`` in ``order``.

    ``bucket`` must be a non-decreasing function of the first order column.
    """
    df = df.withColumn("__bucket", bucket)
    summaries, carried = [], []
    across = Window.partitionBy(*keys).orderBy("__bucket")
    for i, scan in enumerate(scans):
        part, carry = f"__part{i}", f"__carry{i}"
        if scan.op in ("lag", "lead"):
            edge = F.struct(*order, F.struct(F.col(scan.value).alias("v")).alias("payload"))
            pick = F.max if scan.op == "lag" else F.min
            summaries.append(pick(edge).alias(part))
            step = F.lag(part) if scan.op == "lag" else F.lead(part)
            carried.append(step.over(across).getField("payload").getField("v").alias(carry))
            continue
        direction, frame = scan.op.split("_")
        rows = UNBOUNDED_BEFORE if frame == "before" else UNBOUNDED_AFTER
        if direction == "count":
            summaries.append(F.count(F.lit(1)).alias(part))
            fold = F.sum(part)
        else:
            aggregate = {"max": F.max, "min": F.min, "sum": F.sum}[direction]
            summaries.append(aggregate(scan.value).alias(part))
            fold = aggregate(part)
        carried.append(fold.over(across.rowsBetween(*rows)).alias(carry))

    summary = df.groupBy(*keys, "__bucket").agg(*summaries)
    # nothing is carried into a key of one slice, so it sends no row; the join hashes what is left and only the windows sort
    carry_in = summary.select(*keys, "__bucket", *carried).where(" OR ".join(f"__carry{i} IS NOT NULL" for i in range(len(scans))))
    joined = df.join(carry_in.hint("shuffle_hash"), [*keys, "__bucket"], "left")

    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    out = []
    for i, scan in enumerate(scans):
        carry = F.col(f"__carry{i}")
        if scan.op in ("lag", "lead"):
            wrapped = F.struct(F.col(scan.value).alias("v"))
            step = F.lag(wrapped) if scan.op == "lag" else F.lead(wrapped)
            near = step.over(inside)
            out.append(F.when(near.isNotNull(), near.getField("v")).otherwise(carry).alias(scan.name))
            continue
        direction, frame = scan.op.split("_")
        rows = UNBOUNDED_BEFORE if frame == "before" else UNBOUNDED_AFTER
        span = inside.rowsBetween(*rows)
        if direction == "count":
            out.append((F.coalesce(carry, F.lit(0)) + F.count(F.lit(1)).over(span)).alias(scan.name))
        elif direction == "sum":
            local = F.sum(scan.value).over(span)
            out.append(
                F.when(carry.isNull(), local)
                .otherwise(carry + F.coalesce(local, F.lit(0)))
                .alias(scan.name)
            )
        else:
            combine = F.greatest if direction == "max" else F.least
            local = (F.max if direction == "max" else F.min)(scan.value).over(span)
            out.append(combine(carry, local).alias(scan.name))
    kept = [c for c in df.columns if c != "__bucket"]
    return joined.select(*kept, *out)


def time_bucket(column: str, width_ms: int) -> Column:
    """Integer slice number of a millisecond column."""
    return F.floor(F.col(column) / F.lit(width_ms)).cast("bigint")


def ordered_fold(
    rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], name: str, start: Callable[[], tuple], step: Callable[..., tuple],
) -> DataFrame:
    """Add the long column ``name``: what ``step(state, *inputs) -> (state, value)`` gives for each row of a key in order.

    For walks in which a row depends on where the walk stands, so that no window expresses them. Rows are sorted
    by Spark and streamed through with one state per key; a key of any length is read once, in Arrow batches, and
    never gathered. Null inputs reach ``step`` as None.
    """
    columns, at = rows.columns, [rows.columns.index(c) for c in [*keys, *inputs]]
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ()
        for batch in batches:
            values = []
            for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], start()
                state, value = step(state, *row[len(keys) :])
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], [*columns, name])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def follow_jumps(rows: DataFrame, keys: list[str], at: str, to: str, bucket: Column, name: str) -> DataFrame:
    """Add the long column ``name``: the last row at or before each row that a walk from the first row of its key along ``to`` meets.

    ``at`` is the place of a row (a long, distinct within a key), ``to`` a later place of the walk's next row; the walk ends where
    it is null, not later, or the place of no row. ``bucket`` cuts a key into slices, as in :func:`ordered_scan`. Every slice finds, from its end, where a walk that enters
    it at a row leaves it. Only places where some slice is left for another matter between slices: their jumps are doubled, so a key of n
    slices takes about log(n) rounds of joins over all keys at once, each written. Then each slice marks its rows on its own,
    and no exchange is by key alone but for the first place of each key.
    """
    cut = rows.withColumn("__slice", bucket.cast("bigint")).withColumn("__to", F.when(F.col(to) > F.col(at), F.col(to)))
    groups = [*keys, "__slice"]
    carried = cut.columns
    seen = [carried.index(c) for c in (*groups, at, "__to")]

    def leave(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found = None, {}
        for batch in batches:
            exits, lasts = [], []
            for *this, here, beyond in zip(*(batch.column(i).to_pylist() for i in seen), strict=True):
                if this != group:
                    group, found = this, {}
                ending = found.get(beyond, (beyond, here))
                found[here] = ending
                exits.append(ending[0])
                lasts.append(ending[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exits, pa.int64()), pa.array(lasts, pa.int64())], [*carried, "__exit", "__last"])

    # whole rows are staged with what they need later, so their lineage is computed once
    whole = checkpoint(cut.repartition(*groups).sortWithinPartitions(*groups, F.desc(at)).mapInArrow(
        leave, StructType([*cut.schema.fields, StructField("__exit", LongType()), StructField("__last", LongType())])))
    left = whole.select(*groups, at, "__exit", "__last")
    ends = left.groupBy(*keys).agg(F.min(at).alias(at), F.max("__slice").alias("__end"))
    first = ends.select(*keys, at)
    entries = checkpoint(left.join(left.select(*keys, F.col("__exit").alias(at)).unionByName(first).distinct(), [*keys, at]))
    met, hop = checkpoint(first), entries.select(*keys, at, "__exit")
    while True:
        following = hop.select(*keys, F.col(at).alias("__exit"), F.col("__exit").alias("__further"))
        met = checkpoint(met.unionByName(met.join(hop, [*keys, at]).select(*keys, F.col("__exit").alias(at))).distinct())
        hop = checkpoint(hop.join(following, [*keys, "__exit"]).select(*keys, at, F.col("__further").alias("__exit")))
        if hop.isEmpty():
            break
    entered = checkpoint(entries.join(met, [*keys, at], "left_semi"))
    onward = entered.select(*keys, F.col(at).alias("__exit"), F.col("__slice").alias("__until"))
    until = F.coalesce("__until", "__end")
    passed = entered.join(onward, [*keys, "__exit"], "left").join(ends.drop(at), keys).where(until > F.col("__slice")).select(
        *keys, F.explode(F.sequence(F.col("__slice") + 1, until)).alias("__slice"), F.col("__last").alias("__carry"))
    marks = entered.select(*groups, F.col(at).alias("__entry"))
    columns, place = rows.columns, [rows.columns.index(c) for c in (at, to)]
    placed = whole.join(passed, groups, "left").join(marks, groups, "left").select(*columns, "__slice", "__carry", "__entry")
    at_group = [placed.columns.index(c) for c in (*groups, "__carry", "__entry")]

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head, following = None, None, None
        for batch in batches:
            heads = []
            for *this, carry, entry, here, beyond in zip(*(batch.column(i).to_pylist() for i in [*at_group, *place]), strict=True):
                if this != group:
                    group, head, following = this, carry, entry
                if here == following:
                    head, following = here, beyond
                heads.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(heads, pa.int64())], [*columns, name])

    return placed.repartition(*groups).sortWithinPartitions(*groups, at).mapInArrow(mark, StructType([*rows.schema.fields, StructField(name, LongType())]))
