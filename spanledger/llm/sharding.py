"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.session import checkpoint

#: Bits of the key that one round of probes resolves.
STEP = 12
#: Groups above this part of a shard's target are placed on their own; at most shards * FINE of them exist.
FINE = 128
#: Rows in one range of slots.
RANGE_ROWS = 100_000


def _unsigned(column: Column) -> Column:
    """Order of a signed 64-bit hash as a non-negative key of 60 bits."""
    return F.shiftrightunsigned(column, 4)


def _histogram(rows: DataFrame, shift: int) -> dict[int, int]:
    """Exact bytes per key prefix: counted in every partition, summed once."""
    counted = rows.groupBy(F.shiftrightunsigned("k", shift).alias("prefix")).agg(F.sum("size").alias("bytes"))
    return {r["prefix"]: int(r["bytes"]) for r in counted.collect()}  # at most 2**STEP prefixes for each splitter


def find_splitters(rows: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Keys below which about ``targets`` bytes lie; ``rows`` has a 60-bit key ``k`` and ``size``.

    Each round counts the exact bytes below candidate boundaries (all prefixes of the next
    ``STEP`` bits within the interval that holds a target) and keeps the interval in which the target
    falls, until the nearest boundary is within ``tolerance`` bytes or the key is used up.
    """
    found: dict[int, int] = {}
    low: dict[int, tuple[int, int]] = {i: (0, 0) for i in range(len(targets))}  # splitter -> (prefix, bytes before it)
    shift = 60
    while low and shift > 0:
        shift -= STEP
        prefixes = sorted({p for p, _ in low.values()})
        inside = rows if shift == 60 - STEP else rows.filter(F.shiftrightunsigned("k", shift + STEP).isin(prefixes))
        sums = _histogram(inside, shift)
        for i, (prefix, before) in list(low.items()):
            at, best, children = before, ((prefix << STEP) << shift, before), sorted(p for p in sums if p >> STEP == prefix)
            for child in children:
                after = at + sums[child]
                if abs(after - targets[i]) < abs(best[1] - targets[i]):
                    best = ((child + 1) << shift, after)
                if after >= targets[i]:
                    low[i] = (child, at)
                    break
                at = after
            else:
                found[i] = best[0]
                del low[i]
                continue
            if abs(best[1] - targets[i]) <= tolerance or shift == 0:
                found[i] = best[0]
                del low[i]
    ordered = [found[i] for i in range(len(targets))]
    return [max(ordered[: i + 1]) for i in range(len(ordered))]


def place_groups(sizes: dict[int, int], shards: int, target: float) -> tuple[dict[int, int], list[int]]:
    """Largest group first into the emptiest shard; returns the places and the bytes placed."""
    load, places = [0] * shards, {}
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard = min(range(shards), key=lambda s: (load[s], s))
        places[group] = shard
        load[shard] += size
    return places, load


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, keep_rows: bool = False,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot[, row]) of every row, with near-equal bytes per shard.

    With ``keep_rows`` the whole row travels along the one exchange, packed in ``row``.

    Size is the UTF-8 length of the text plus 1 (a null text counts as empty). Rows of equal
    text stay together in a shard while their group fits into one; a group that is larger than a
    shard's target is dealt out row by row, as near-equal bytes demand, by a hash with the number of the row in its scan, so rows equal
    in everything part too (a scan that deals rows anew changes only which of them goes where). Keys are 60 bits of the text's hash. Groups above 1/128 of a target, at most ``shards`` * 128 of them
    whatever the input, are placed first, and the histogram sort cuts the keys of all other
    rows where the room that is left in each shard is filled. Slots number each shard's
    rows from 0 without gaps in a seeded random order, within ranges of bounded size
    that are shuffled once. Null and repeated ids are ordinary rows; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else []
    whole = docs.select(
        *carried, F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _unsigned(F.xxhash64(text)).alias("group"), F.xxhash64(text, F.col(id_col), F.monotonically_increasing_id()).alias("mix"),
    )
    rows = checkpoint(whole.drop("row"))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    target = total / shards
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * FINE > F.lit(target))
    sizes = {r["group"]: int(r["bytes"]) for r in large.collect()}  # at most shards * FINE of them
    split = [g for g, size in sizes.items() if size > target]
    places, load = place_groups({g: size for g, size in sizes.items() if size <= target}, shards, target)
    free = rows.select("size", F.when(F.col("group").isin(split), _unsigned(F.col("mix"))).otherwise(F.col("group")).alias("k"), "group")
    free = free.filter(~F.col("group").isin(list(places))) if places else free
    rest = total - sum(load)
    room, level = _fill(load, rest)
    targets = [sum(room[: i + 1]) for i in range(shards - 1)]
    cuts = find_splitters(free, targets, tolerance * target) if rest else [0] * (shards - 1)

    key = F.when(F.col("group").isin(split), _unsigned(F.col("mix"))).otherwise(F.col("group")) if split else F.col("group")
    by_key = sum(((key >= cut).cast("int") for cut in cuts), F.lit(0))
    placed = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("group")] if places else F.lit(None)
    kept = ["row"] if keep_rows else []
    # whole rows are read once more and go through the exchange; only what places them is staged
    dealt = (whole if keep_rows else rows).select(*kept, "id", "size", "text_crc32", "mix", F.coalesce(placed, by_key).cast("int").alias("shard"))

    bits = max(6, math.ceil(math.log2(max(1, count) / shards / RANGE_ROWS + 1)))
    dealt = dealt.withColumn("range", F.shiftrightunsigned("mix", 64 - bits))
    per = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("shard", "range", before.alias("start"))
    order = Window.partitionBy("shard", "range").orderBy("mix", "id", "size", "text_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(order)).join(starts, ["shard", "range"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), *kept)
    )


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row as it lies in the shards; sizes and checksums are taken from the texts there."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return spark.read.parquet(path).select(
        F.col("row")[id_col].alias(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs`` with its ``shard`` and ``slot``, a folder per shard, files in order of slots. An empty table leaves a folder without rows."""
    rows = shard_documents(docs, shards, id_col, text_col, keep_rows=True)
    rows = rows.select("row", "slot", "shard").sortWithinPartitions("shard", "slot")
    if docs.isEmpty():
        rows.write.parquet(path)
    else:
        rows.write.partitionBy("shard").parquet(path)


def _fill(load: list[int], rest: float) -> tuple[list[float], float]:
    """Room each shard gets of ``rest`` bytes so that the fullest stays as low as can be."""
    level, order = 0.0, sorted(load)
    for n in range(1, len(order) + 1):
        level = (rest + sum(order[:n])) / n
        if n == len(order) or level <= order[n]:
            break
    return [max(0.0, level - x) for x in load], level
