"""Predicates and arithmetic on half-open millisecond intervals ``[start, end)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def overlap_ms(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start)).cast("bigint")


def midpoint(start: Column, end: Column) -> Column:
    return start + F.floor((end - start) / 2).cast("bigint")


def is_probability(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & value.between(0.0, 1.0)


def epoch_ms(ts: Column) -> Column:
    """Truncated milliseconds since the epoch, whatever the timestamp flavour."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("bigint")
