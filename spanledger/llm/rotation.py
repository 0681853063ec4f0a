"""Embedding near-duplicates by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.components import connected_components
from spanledger.session import checkpoint

#: Rows of one block of a bucket; a task compares at most two blocks at a time.
BLOCK = 1024
#: Width of the confidence bound in standard deviations of the estimate.
WIDTH = 6.0
#: Row pairs held at once in a task, and pairs evaluated at once.
CHUNK = 500_000
PART = 32_768


def rotations(dims: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices side by side: (dims, count * dims)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def encode(unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors and, per vector, the correction <code, vector>.

    The code of a vector is the +-1 vector of its signs, scaled to unit length. Its inner
    product with the vector itself is the correction factor: <code, y> / factor is an
    unbiased estimate of <x, y> over random rotations.
    """
    turned = unit @ turns
    bits = turned >= 0
    factor = np.abs(turned).sum(axis=1) / turns.shape[1] * math.sqrt(turns.shape[0])
    return np.packbits(bits, axis=1), factor


def plan(count: int, dims: int, cosine: float, miss: float, per_bucket: int = 16) -> tuple[int, int]:
    """Bits of a key and number of tables so that a pair at ``cosine`` is missed with probability ``miss`` at most."""
    bits = max(4, math.ceil(math.log2(max(2, count) / per_bucket)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _keys(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    plain = np.unpackbits(codes, axis=1)[:, : bits * tables].reshape(len(codes), tables, bits)
    return plain.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


class _Matcher:
    """Exact links among the rows of bucket blocks; counts a pair in the first table that holds it only."""

    def __init__(self, turns: np.ndarray, cosine: float, bits: int, tables: int) -> None:
        self.turns, self.cosine, self.bits, self.tables = turns, cosine, bits, tables
        self.scale = 1 / math.sqrt(turns.shape[1] // turns.shape[0]) / math.sqrt(max(1, turns.shape[0] - 1))

    def candidates(self, unit, codes, factors, a, b):
        """Pairs whose estimate plus bound reaches the threshold: <code_a, b> / factor_a +- width * error."""
        signs = np.unpackbits(codes, axis=1)[:, : self.turns.shape[1]].astype(np.float32) * 2 - 1
        turned = (unit @ self.turns).astype(np.float32)
        keep = []
        for at in range(0, len(a), PART):
            i, j = a[at : at + PART], b[at : at + PART]
            rows, where = np.unique(i, return_inverse=True)
            if len(rows) * len(np.unique(j)) <= 4 * len(i):  # dense: one product of matrices
                cols, there = np.unique(j, return_inverse=True)
                dot = (signs[rows] @ turned[cols].T)[where, there]
            else:
                dot = np.einsum("ij,ij->i", signs[i], turned[j])
            estimate = dot * (math.sqrt(self.turns.shape[0]) / self.turns.shape[1]) / factors[i]
            error = WIDTH * self.scale * np.sqrt(np.maximum(1 - factors[i] ** 2, 0)) / factors[i]
            keep.append(estimate + error >= self.cosine)
        return np.concatenate(keep) if keep else np.zeros(0, bool)

    def links(self, unit, codes, factors, table, a, b):
        """Row pairs (a, b) with an exact cosine at the threshold or above, first met in ``table``."""
        kept = self.candidates(unit, codes, factors, a, b)
        a, b = a[kept], b[kept]
        out = []
        keys = _keys(codes, self.bits, self.tables)
        for at in range(0, len(a), PART):
            i, j = a[at : at + PART], b[at : at + PART]
            linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= self.cosine
            i, j = i[linked], j[linked]
            first = (keys[i] == keys[j]).argmax(axis=1) == table[i]
            out.append((i[first], j[first]))
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (a[:0], b[:0])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of one block, so that few edges leave the task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            edges.append((x, y))
    return edges


def _group_pairs(start: np.ndarray, stop: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of consecutive groups, a bounded number at a time; side 0 pairs with itself and side 1, side 1 with side 0."""
    held_a, held_b, held = [], [], 0
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        if e - s < 2:
            continue
        sides = side[s:e]
        if sides.any():
            left, right = np.flatnonzero(sides == 0) + s, np.flatnonzero(sides == 1) + s
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            a, b = np.triu_indices(e - s, 1)
            a, b = a + s, b + s
        held_a.append(a)
        held_b.append(b)
        held += len(a)
        if held >= CHUNK:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, held = [], [], 0
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 1e-3, seed: int = 7,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs with a cosine of ``cosine`` or more.

    Equal vectors are grouped first; a group stands for all its rows. Every distinct unit
    vector is rotated at random several times and keeps the sign bits as its code, with the
    correction factor <code, vector>. Slices of the code are the keys of ``tables`` hash tables, as many as make the
    chance of missing a pair right at the threshold ``miss`` at most (less for nearer pairs);
    key width grows with the number of vectors, so buckets of unrelated vectors keep their size.
    Pairs of a bucket are estimated from code and factor, without bias and with a confidence
    bound of ``WIDTH`` deviations; only pairs whose bound reaches the threshold are computed
    again in double precision, so no link below it is reported. Buckets above ``BLOCK`` rows
    are cut into blocks, and each pair of blocks is a task's work of its own: nothing is capped.
    Tasks return counts per vector and a spanning forest, never all pairs of a group. Work
    in a family of G near (not equal) vectors grows as its exact link counts do, with G squared, spread over all tasks.

    Vectors that are null, empty, zero or hold null or non-finite components get no link, as
    do those of another length than the most common one (with which a cosine is not defined).
    Rows of a null id count like any other and stand last in the choice of the least id; repeated ids are separate rows.
    """
    spark = vectors.sparkSession
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select(F.col(id_col).alias("id"), plain.alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    width = rows.filter("good").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = width["d"] if width else 0
    rows = rows.withColumn("good", F.col("good") & (F.size("v") == dims))
    rows = rows.withColumn("h", F.when(F.col("good"), F.md5(F.to_json(F.struct("v")).cast("binary"))))
    # a vector is known by a digest of its exact components
    groups = checkpoint(rows.filter("good").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v")))
    count = groups.count()
    if not count:
        none = rows.select("id").withColumns({"n_links": F.lit(0).cast("bigint"), "component_id": F.col("id"), "kept": F.lit(True)})
        return none.withColumnRenamed("id", id_col)
    bits, tables = plan(count, dims, cosine, miss)
    numbered = checkpoint(groups.select(F.monotonically_increasing_id().alias("n"), "h", "first", "copies", "v"))
    turns = rotations(dims, math.ceil(bits * tables / dims), seed)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(2).flatten()).reshape(batch.num_rows, dims)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes, factors = encode(unit, turns)
            keys = _keys(codes, bits, tables)
            for at in range(0, batch.num_rows, 2048):
                part = slice(at, min(at + 2048, batch.num_rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], batch.column(1)[part], pa.FixedSizeListArray.from_arrays(pa.array(unit[part].ravel()), dims).cast(pa.list_(pa.float64())),
                    pa.array([c.tobytes() for c in codes[part]], pa.binary()), pa.array(factors[part]),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys[part].ravel()), tables).cast(pa.list_(pa.int64())),
                ], ["n", "copies", "unit", "code", "factor", "keys"])

    coded = checkpoint(numbered.select("n", "copies", "v").mapInArrow(code, "n bigint, copies bigint, unit array<double>, code binary, factor double, keys array<bigint>"))
    entries = coded.select("n", F.posexplode("keys").alias("t", "key"))
    sizes = checkpoint(entries.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1"))
    members = coded.select("n", "copies", "unit", "code", "factor", F.posexplode("keys").alias("t", "key")).join(sizes, ["t", "key"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("n"), blocks).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("own", own).select(
        "t", "key", "n", "copies", "unit", "code", "factor", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"),
    )
    work = spread.select("t", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "n", "copies", "unit", "code", "factor")
    dealt = work.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    matcher = _Matcher(turns, cosine, bits, tables)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            group, table, side, n, copies, unit, codes, factors = rows
            edges = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            start, stop = np.concatenate(([0], edges)), np.concatenate((edges, [len(n)]))
            for a, b in _group_pairs(start, stop, side):
                used, where = np.unique(np.concatenate((a, b)), return_inverse=True)
                i, j = matcher.links(unit[used], codes[used], factors[used], table[used], where[: len(a)], where[len(a) :])
                if not len(i):
                    continue
                links = np.zeros(len(used), dtype=np.int64)
                np.add.at(links, i, copies[used][j])
                np.add.at(links, j, copies[used][i])
                ids = n[used]
                forest = _forest(ids[i], ids[j])
                some = np.flatnonzero(links)
                left = np.concatenate((ids[some], [e[0] for e in forest])).astype(np.int64)
                right = [None] * len(some) + [e[1] for e in forest]
                yield pa.RecordBatch.from_arrays([
                    pa.array(left), pa.array(right, pa.int64()), pa.array(links[some].tolist() + [0] * len(forest), pa.int64()),
                ], ["n", "other", "links"])

    found = checkpoint(dealt.mapInArrow(match, "n bigint, other bigint, links bigint"))
    counts = found.filter("other IS NULL").groupBy("n").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("other IS NOT NULL").select("n", "other"))
    joined = numbered.select("n", "h", "first", "copies").join(counts, "n", "left").join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    per = joined.join(least, "root").select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter("good").select("id", "h").join(per, "h").select("id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Arrow batches of sorted rows, cut so that no group (two blocks at most) is divided."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = _group_of(batch)
        if held and last is not None and not np.array_equal(last, group[0]):
            yield _columns(held)
            held = []
        cut = np.flatnonzero(np.any(group != group[-1], axis=1))
        if len(cut):
            split = int(cut[-1]) + 1
            held.append(batch.slice(0, split))
            yield _columns(held)
            held = [batch.slice(split)]
        else:
            held.append(batch)
        last = group[-1]
    if held:
        yield _columns(held)


def _group_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], axis=1)


def _columns(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held).combine_chunks()
    batch = table.to_batches(max_chunksize=max(1, table.num_rows))[0]
    unit = np.asarray(batch.column(7).flatten()).reshape(batch.num_rows, -1)
    codes = np.frombuffer(b"".join(batch.column(8).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
    group = _group_of(batch)
    return group, group[:, 0], np.asarray(batch.column(4)), np.asarray(batch.column(5)), np.asarray(batch.column(6)), unit, codes, np.asarray(batch.column(9))
