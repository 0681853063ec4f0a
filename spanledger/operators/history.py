"""Job and run history: due work, ownership, state roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_due(as_of: Column) -> Column:
    """Waiting work whose time has come, or running work whose lease expired."""
    waiting = F.col("status").isin("PENDING", "RETRY_WAIT") & (F.col("next_attempt_at") <= as_of)
    expired = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= as_of)
    return waiting | expired


def claimable(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(is_due(as_of) & ~F.col("cancel_requested") & (F.col("attempt_count") < F.col("max_attempts")))


def has_owner(as_of: Column) -> Column:
    named = F.regexp_replace(F.coalesce("worker_id", F.lit("")), r"^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$", "") != ""
    return (F.col("status") == "RUNNING") & named & (F.col("lease_expires_at") > as_of)


def recoverable_stages(stages: DataFrame, as_of: Column) -> DataFrame:
    """Due stages; the LLM stage also needs its run's transcription to have succeeded."""
    ready = stages.where("stage_name = 'TRANSCRIPTION' AND status = 'SUCCEEDED'").select("run_id").distinct()
    due = stages.where(is_due(as_of))
    return due.where("stage_name <> 'LLM'").unionByName(
        due.where("stage_name = 'LLM'").join(ready, "run_id", "left_semi")
    )


def job_state(log: DataFrame, max_attempts: int) -> DataFrame:
    """Latest state per job; a failure with attempts left becomes RETRY_WAIT, a cancel request wins.

    One partial aggregation; a job with a very long log is combined before the shuffle.
    """
    last = F.max(F.struct("ts", "event_id", "status", "lease_expires_at")).alias("last")
    facts = log.groupBy("job_id").agg(
        last, F.sum(F.when(F.col("status") == "RUNNING", 1).otherwise(0)).alias("attempts"),
        F.max("cancel_requested").alias("cancelled"), F.count(F.lit(1)).alias("entries"),
    )
    settled = F.col("last.status") == "SUCCEEDED"
    state = (
        F.when(F.col("cancelled") & ~settled, "CANCELLED")
        .when((F.col("last.status") == "FAILED") & (F.col("attempts") < max_attempts), "RETRY_WAIT")
        .otherwise(F.col("last.status"))
    )
    return facts.select(
        "job_id", state.alias("state"), "attempts", "entries",
        F.when(F.col("last.status") == "RUNNING", F.col("last.lease_expires_at")).alias("lease_expires_at"),
    )


def worst_status(status: str) -> Column:
    """Aggregate: any FAIL, else any NOT_RUN, else PASS."""
    severity = F.when(F.col(status) == "FAIL", 2).when(F.col(status) == "NOT_RUN", 1).otherwise(0)
    worst = F.max(severity)
    return F.when(worst == 2, "FAIL").when(worst == 1, "NOT_RUN").otherwise("PASS")


def ordered_warnings(rows: DataFrame, keys: list[str], position: str, warning: str) -> DataFrame:
    """Distinct warnings in order of first appearance (the set of codes is small and closed)."""
    first = rows.groupBy(*keys, warning).agg(F.min(position).alias("__p"))
    return first.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", F.col(warning).alias("w")))), lambda x: x["w"]).alias("warnings")
    )


def metric_rollup(metrics: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Sum metrics by name over a closed name list, filling zeros.

    A sum past 2^63-1 fails under ANSI mode.
    """
    sums = metrics.groupBy(*keys, "name").agg(F.sum("value").alias("__v"))
    wanted = metrics.select(*keys).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    return wanted.join(sums, [*keys, "name"], "left").select(*keys, "name", F.coalesce("__v", F.lit(0)).alias("value"))


def audio_status(warnings: DataFrame, runs: DataFrame, keys: list[str], position: str, warning: str) -> DataFrame:
    """Status of audio runs: any warning of any stage makes a finished run a partial one. Warnings come once each, as first seen."""
    seen = ordered_warnings(warnings, keys, position, warning)
    found = F.coalesce(F.col("warnings"), F.array().cast("array<string>"))
    return runs.select(*keys).distinct().join(seen, keys, "left").select(*keys, found.alias("warnings"), F.when(F.size(found) > 0, "PARTIAL_SUCCEEDED").otherwise("SUCCEEDED").alias("status"))
