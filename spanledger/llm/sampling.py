"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id gives null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def bounded_sample(rows: DataFrame, label: str, counts: dict, per_label: int, seed: int, id_col: str = "id") -> DataFrame:
    """At most ``per_label`` rows of each label in ``counts`` (label to number of rows), the least by a hash of the id.

    A label with many rows is first cut to the lowest share of the hash range that holds about four times the
    sample, so each task hands a few rows on, however many tasks there are.
    """
    order = F.xxhash64(id_col, F.lit(seed))
    parts = []
    for value, count in sorted(counts.items()):
        share = min(1.0, (4 * per_label + 100) / count)
        highest = min(2**63 - 1, int(share * 2**64) - 2**63)
        parts.append(rows.filter((F.col(label) == F.lit(value)) & (order <= F.lit(highest))).orderBy(order, id_col).limit(per_label))
    return reduce(DataFrame.unionByName, parts)


def labelled_texts(docs: DataFrame, marks: DataFrame, counts: dict, per_label: int, seed: int, id_col: str, text_col: str) -> list[tuple[str, object]]:
    """(text, label) of a bounded sample of ``marks`` (id, label), in a fixed order; the driver holds the sample only."""
    chosen = bounded_sample(marks, "label", counts, per_label, seed)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: (r["id"], str(r["label"])))]
