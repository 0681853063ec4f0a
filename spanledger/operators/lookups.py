"""Reference lookups: containment, ownership, resolution, orphans and bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.spans import as_of_owner, contained_in


def owner_status(evidence: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Covering range of every evidence row and whether it straddles or has none."""
    owned = as_of_owner(evidence, ranges, keys)
    ends = ranges.select(*keys, F.col("start_ms").alias("owner_start"), F.col("end_ms").alias("owner_end"))
    status = (
        F.when(F.col("owner_end").isNull() | (F.col("start_ms") >= F.col("owner_end")), "UNASSIGNED")
        .when(F.col("end_ms") > F.col("owner_end"), "STRADDLES").otherwise("OWNED")
    )
    return owned.join(ends, [*keys, "owner_start"], "left").withColumn("status", status)


def not_exactly_one_owner(evidence: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence contained in no range or in several."""
    inside = contained_in(evidence.select(*keys, "evidence_id", "start_ms", "end_ms"), ranges, keys)
    counts = inside.groupBy(*keys, "evidence_id").agg(F.count(F.lit(1)).alias("owners"))
    return evidence.select(*keys, "evidence_id").join(counts, [*keys, "evidence_id"], "left").select(
        *keys, "evidence_id", F.coalesce("owners", F.lit(0)).cast("bigint").alias("owners")
    ).where("owners <> 1")


def unknown_refs(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def orphans(items: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    return items.join(refs.select(F.col(ref).alias(key)).distinct(), key, "left_anti")


def binding_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key with the number of rows on each side and a verdict."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("__a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("__b"))
    na, nb = F.coalesce("__a", F.lit(0)).cast("bigint"), F.coalesce("__b", F.lit(0)).cast("bigint")
    verdict = (
        F.when(na == 0, "UNEXPECTED").when(nb == 0, "MISSING").when((na > 1) | (nb > 1), "DUPLICATE").otherwise("BOUND")
    )
    return a.join(b, key, "full").select(key, na.alias("left_rows"), nb.alias("right_rows"), verdict.alias("verdict"))


def idempotent_requests(requests: DataFrame, existing: DataFrame, key: str, config: str) -> DataFrame:
    """NEW, REUSED or CONFLICT for each request against the stored runs."""
    stored = existing.select(key, F.col(config).alias("__stored"))
    verdict = (
        F.when(F.col("__stored").isNull(), "NEW").when(F.col("__stored") == F.col(config), "REUSED").otherwise("CONFLICT")
    )
    return requests.join(stored, key, "left").withColumn("outcome", verdict).drop("__stored")


def uncovered_targets(required: DataFrame, frames: DataFrame, keys: list[str], target: str) -> DataFrame:
    return required.select(*keys, target).distinct().join(frames.select(*keys, target), [*keys, target], "left_anti")


def ordered_refs(refs: DataFrame, keys: list[str], position: str, value: str | Column) -> DataFrame:
    """Re-collect resolved references of one owner in their stored order."""
    value = F.col(value) if isinstance(value, str) else value
    return refs.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v")))), lambda r: r["v"]
        ).alias("values")
    )
