"""Row generators: windows, grid points and small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_windows(runs: DataFrame, key: str, duration: str, width_ms: int) -> DataFrame:
    """Tumbling windows over ``[0, duration)``; the last one is short."""
    count = F.ceil(F.col(duration) / width_ms).cast("bigint")
    index = F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("chunk_index")
    rows = runs.where(F.col(duration) > 0).select(key, F.col(duration).alias("__d"), index)
    start = F.col("chunk_index") * width_ms
    return rows.select(
        key, "chunk_index", start.alias("start_ms"),
        F.least(F.col("__d"), start + width_ms).alias("end_ms"),
    )


def grid_points(runs: DataFrame, key: str, duration: str, step_ms: int) -> DataFrame:
    """Interior multiples of ``step_ms``."""
    last = F.floor((F.col(duration) - 1) / step_ms).cast("bigint")
    steps = F.transform(F.sequence(F.lit(1).cast("bigint"), last), lambda k: k * step_ms)
    return runs.where(F.col(duration) > step_ms).select(key, F.explode(steps).alias("timestamp_ms"))
