"""Substring deduplication by hashing normalised lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spanledger.session import checkpoint, settled

#: A unit ends at a line end, or at white space after the end of a sentence.
SEPARATOR = re.compile(r"(?<=[.!?])[ \t\r]|\n")
#: Shorter units repeat by chance; they count together with the unit before them, or not at all.
MIN_WORDS = 5
#: Letters, digits and everything beyond ASCII make words; case is folded before.
WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def unit_spans(text: str) -> list[tuple[int, int]]:
    """(start, stop) of every unit, in characters; a unit holds the separator that ends it, so units cover the text."""
    cuts = [m.end() for m in SEPARATOR.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip([0, *cuts[:-1]], cuts, strict=True)) if text else []


def digests(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[bytes]]:
    """Places and 128-bit digests of the units of a text.

    A unit of fewer than ``min_words`` words is hashed with the words of the unit before it, so it counts as repeated
    where that unit repeats with it; it has no digest where both together are still too short.
    """
    places, out, before = [], [], []
    for place, (start, stop) in enumerate(unit_spans(text)):
        words = text[start:stop].lower().encode("utf-8", "replace").translate(WORD_BYTES).split()
        hashed = words if len(words) >= min_words or not words else before + words
        if len(hashed) >= min_words:
            places.append(place)
            out.append(xxhash.xxh3_128_digest(b" ".join(hashed)))
        before = words
    return places, out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows packed into one column, so that no name of theirs can clash, beside id, text and text hash."""
    packed = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.select(packed, docs[id_col].alias("_id"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_hash"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _hash, places): the units of each document that an earlier ranked unit repeats.

    Rank is (id, text hash, place), with null ids last. Digests are counted with partial aggregation over
    all documents; only those that occur more than once take part in the ranking, so a line in a
    third of all documents is one row per task before the shuffle and is never gathered.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                places, high, low, sizes = [], [], [], [0]
                for text in part.column(1):
                    where, found = digests(text.as_py() or "", min_words)
                    places += where
                    halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                    high.append(halves[:, 0])
                    low.append(halves[:, 1])
                    sizes.append(len(places))
                offsets = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (high, low)),
                ], ["_id", "_hash", "place", "high", "low"])

    rows = _keyed(docs, id_col, text_col).select("_id", "_text", "_hash").mapInArrow(run, f"_id {kind}, _hash bigint, place array<int>, high array<bigint>, low array<bigint>")
    units = checkpoint(rows).select("_id", "_hash", F.inline(F.arrays_zip("place", "high", "low")))
    # written tables on one side let Spark split a digest that very many units share
    twice = checkpoint(units.groupBy("high", "low").count().filter("count > 1").select("high", "low"))
    shared = checkpoint(units.join(twice, ["high", "low"]))
    rank = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_hash").alias("hash"), F.col("place").alias("place"))
    first = checkpoint(shared.groupBy("high", "low").agg(F.min(rank).alias("first")))
    later = shared.join(first, ["high", "low"]).filter(~rank.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, removed) of every row of ``docs``: the row as it was, its text without repeated units, and what was cut.

    Units are sentences within lines, compared after case folding and without punctuation and white space; those of
    fewer than ``min_words`` words go only together with the unit before them. The earliest occurrence over all documents is kept, also within one document.
    ``removed`` holds (start, stop) in characters of the original text, in order and joined where they
    touch. Null texts stay null. Rows with the same id and the same text are one document seen again: all get the same result.
    """
    places = settled(docs.sparkSession, lambda: repeated_units(docs, id_col, text_col, min_words)).select(F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "places")
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(places, keyed["_id"].eqNullSafe(F.col("_rid")) & (keyed["_hash"] == F.col("_rhash")), "left").select("row", "_text", "places")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            texts, removed = [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                text, cut = _without(text.as_py(), gone.as_py() or [])
                texts.append(text)
                removed.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, spans)], ["row", "text", "removed"])

    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
    return joined.mapInArrow(run, StructType([joined.schema["row"], StructField("text", StringType()), StructField("removed", span)]))


def _without(text: str | None, gone: list[int]) -> tuple[str | None, list[dict]]:
    """A text without the units at ``gone`` (in order), and their spans."""
    if not text or not gone:
        return text, []
    spans, cut, kept, at = unit_spans(text), [], [], 0
    for place in gone:
        start, stop = spans[place]
        kept.append(text[at:start])
        at = stop
        if cut and cut[-1]["stop"] == start:
            cut[-1]["stop"] = stop
        else:
            cut.append({"start": start, "stop": stop})
    return "".join([*kept, text[at:]]), cut
