"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.session import checkpoint


def _star(pairs: DataFrame, upward: bool) -> DataFrame:
    """Hang neighbours in ``pairs`` (node, other) on the least node of the neighbourhood.

    Upward: only neighbours above the node move (large star). Else all move, and the node with them (small star).
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    movers = pairs.filter(F.col("other") > F.col("node")) if upward else pairs
    moved = movers.join(least, "node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    if not upward:
        moved = moved.unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """A digest of an edge set; two rounds with equal digests have converged."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Least node of the component of every node that has an edge.

    ``edges`` has two columns of one orderable type, in any order and with repeats or
    loops; the result is (node, root). Rows with a null end are left out. Each round costs
    two aggregations and two joins over the edges left, and there are about log(n) rounds.
    Hubs are safe: minima are aggregated before the shuffle and the joins can be split.
    Every round is written to the shared checkpoint folder, so a lost executor costs a round at most.
    """
    left, right = edges.columns
    current = checkpoint(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    )
    state = _state(current)
    while True:
        both = current.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _star(both, True)
        small = _star(large.select(F.col("a").alias("node"), F.col("b").alias("other")), False)
        current = checkpoint(small)
        after = _state(current)
        if after == state:
            break
        state = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
