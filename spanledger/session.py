"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Stage tables written so far by the step that ``settled`` is building.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def build_session(app_name: str = "spanledger", cores: str | int = 8) -> SparkSession:
    """Local session for tests and benches; clusters bring their own session."""
    cores = os.environ.get("BENCH_CPUS", str(cores))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A single-process session has one disk, so a folder is made and set where none is
    configured; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stage_table(df: DataFrame) -> str:
    """Write a stage of a job as Parquet in the shared folder and return its path."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    staged = _STAGED.get()
    if staged is not None:
        staged.append(path)
    df.write.parquet(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back.

    A written table survives lost executors, is read by column, and has a known size,
    so later joins can tell whether a side is small enough to broadcast.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_table(df))


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``checkpoint`` of what ``build`` returns; the stage tables written on the way there are deleted afterwards."""
    staged: list[str] = []
    outer = _STAGED.set(staged)
    try:
        df = build()
    finally:
        _STAGED.reset(outer)
    out = checkpoint(df)
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, staged):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows before costly per-row work, whatever the input splits look like; the number of partitions is Spark's to choose."""
    return df.repartition(*keys)
