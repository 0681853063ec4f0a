"""Rules of annotations, judgments and planning inputs, over one row per boundary, fact, name or reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions.text import normalize_text
from spanledger.operators.closure import violation
from spanledger.operators.scan import Scan, ordered_scan


def repeated_ids(rows: DataFrame, sample: str, value: str, rule: str) -> DataFrame:
    counts = rows.groupBy(sample, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(counts, rule, F.col(sample), F.col(value), None, F.col("n"))


def boundary_rules(boundaries: DataFrame, samples: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """Boundaries outside their media, and boundaries that are not above the one before them.

    ``boundaries``: sample_id, position, at_ms. ``samples``: sample_id, duration_ms.
    """
    timed = boundaries.join(samples.select("sample_id", "duration_ms"), "sample_id")
    outside = timed.where("at_ms < 0 OR at_ms >= duration_ms")
    before = ordered_scan(boundaries.select("sample_id", "position", "at_ms"), ["sample_id"], ["position"], F.floor(F.col("position") / slice_rows), [Scan("before_ms", "lag", "at_ms")])
    return violation(outside, "BOUNDARY_OUTSIDE", F.col("sample_id"), F.col("position"), None, F.col("at_ms")).unionByName(
        violation(before.where("at_ms <= before_ms"), "BOUNDARY_ORDER", F.col("sample_id"), F.col("position"), None, F.col("at_ms")))


def annotation_rules(samples: DataFrame, boundaries: DataFrame, frames: DataFrame, facts: DataFrame, key_facts: DataFrame) -> DataFrame:
    """All rules of an annotation but those on its terms.

    ``frames``: sample_id, frame_id, timestamp_ms. ``facts`` and ``key_facts``: sample_id, fact_id. Key facts are facts, once each; frames lie within
    the media; frame and fact ids are unique.
    """
    late = frames.join(samples.select("sample_id", "duration_ms"), "sample_id").where("timestamp_ms >= duration_ms")
    unknown = key_facts.select("sample_id", "fact_id").distinct().join(facts.select("sample_id", "fact_id").distinct(), ["sample_id", "fact_id"], "left_anti")
    return reduce(DataFrame.unionByName, [
        boundary_rules(boundaries, samples), violation(late, "FRAME_AFTER_END", F.col("sample_id"), F.col("frame_id"), None, F.col("timestamp_ms")),
        repeated_ids(frames, "sample_id", "frame_id", "FRAME_REPEATED"), repeated_ids(facts, "sample_id", "fact_id", "FACT_REPEATED"),
        violation(unknown, "KEY_FACT_UNKNOWN", F.col("sample_id"), F.col("fact_id")), repeated_ids(key_facts, "sample_id", "fact_id", "KEY_FACT_REPEATED")])


def hint_reference_rules(samples: DataFrame) -> DataFrame:
    """Pairs whose two samples refer to different references. ``samples``: pair_id, reference_sha256."""
    differ = samples.groupBy("pair_id").agg(F.min("reference_sha256").alias("lo"), F.max("reference_sha256").alias("hi")).where("lo <> hi")
    return violation(differ, "HINT_REFERENCE", F.col("pair_id"), F.col("pair_id"))


def judgment_rules(matched: DataFrame, key_facts: DataFrame, fabricated: DataFrame, aliases: DataFrame) -> DataFrame:
    """Judgments that name unknown key facts, a fact or a name twice, a blank name, or call a known person's alias fabricated.

    ``matched`` and ``key_facts``: sample_id, fact_id. ``fabricated`` and ``aliases``: sample_id, name; names are compared after normalisation.
    """
    unknown = matched.select("sample_id", "fact_id").distinct().join(key_facts.select("sample_id", "fact_id").distinct(), ["sample_id", "fact_id"], "left_anti")
    keyed = lambda rows: rows.select("sample_id", normalize_text(F.col("name")).alias("name"))
    names = keyed(fabricated)
    known = names.where("name <> ''").distinct().join(keyed(aliases).distinct(), ["sample_id", "name"], "left_semi")
    return reduce(DataFrame.unionByName, [
        violation(unknown, "KEY_FACT_UNKNOWN", F.col("sample_id"), F.col("fact_id")), repeated_ids(matched, "sample_id", "fact_id", "KEY_FACT_REPEATED"),
        violation(names.where("name = ''"), "NAME_BLANK", F.col("sample_id"), F.col("name")), repeated_ids(names.where("name <> ''"), "sample_id", "name", "NAME_REPEATED"),
        violation(known, "NAME_IS_KNOWN", F.col("sample_id"), F.col("name"))])
