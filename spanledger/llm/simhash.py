"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.components import connected_components
from spanledger.session import checkpoint

#: Fingerprints in one bucket of the segment tables before the exact fallback takes over.
BUCKET = 256
#: Words of 64 bits in a wide fingerprint.
WORDS = 4
#: Minima that make the key of a table.
ROWS = 6
#: Entries of one block of a bucket.
BUCKET_BLOCK = 2048
#: Texts and characters of one block of a group whose pairs are compared.
BLOCK = 512
BLOCK_CHARS = 16_000_000


def shingle_hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, repeats included; of all its words where there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed long; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text is unpacked in pieces
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as a signed long; zero without words."""
    return majority(shingle_hashes(text, width, seed))


def wide_fingerprint(text: bytes | None, width: int = 5, seed: int = 42) -> list[int]:
    """``WORDS`` independent 64-bit SimHashes; further hashes of a shingle are mixed from its first one."""
    hashes, out = shingle_hashes(text, width, seed), []
    for k in range(WORDS):
        mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(mixed ^ (mixed >> np.uint64(31))))
    return out


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint long) of every row; a null or wordless text has fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), width, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fingerprint bigint")
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits (0 or 1) within a segment of ``bits`` bits."""
    return [0] + ([1 << i for i in range(bits)] if radius else [])


def links_within_two(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect fingerprints of at most two differing bits.

    ``prints`` holds distinct longs in column ``fp``. Two 32-bit segments make two tables.
    Of two differing bits, either at most one falls in the high segment, or both do and the
    low segments are equal. So each fingerprint looks up the 33 keys at distance 0 or 1 of
    its high segment and its own low segment, and every match is verified over all 64 bits.

    A bucket of more than ``BUCKET`` fingerprints (a large family of near copies) would
    multiply candidates. Fingerprints that would look into one go an exact other way: each
    names the 65 points within distance 1 of itself, and fingerprints that name a common
    point are within two bits of each other, and all such pairs do name one. At most 65
    fingerprints can name a point, so these groups are bounded; they yield star edges.
    The edges have the same components as the full link graph; none is lost.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))
    entries = prints.select("fp", F.explode(table).alias("e")).select("e.seg", "e.key", F.col("fp").alias("b"))
    near = F.transform(F.array(*[F.lit(m).cast("bigint") for m in _ball(32, 1)]), lambda m: F.struct(F.lit(0).alias("seg"), high.bitwiseXOR(m).alias("key")))
    probes = prints.select("fp", F.explode(F.concat(near, F.array(F.struct(F.lit(1).alias("seg"), low.alias("key"))))).alias("e")).select("e.seg", "e.key", F.col("fp").alias("a"))

    full = checkpoint(entries.groupBy("seg", "key").count().filter(F.col("count") > BUCKET).select("seg", "key"))
    found = (
        probes.join(entries.join(full, ["seg", "key"], "left_anti"), ["seg", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    )
    crowded = probes.join(full, ["seg", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    points = F.array(*[F.lit(m).cast("bigint") for m in [0, *(1 << i for i in range(63)), -(1 << 63)]])
    centres = crowded.select("fp", F.explode(F.transform(points, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    grouped = centres.groupBy("point").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)  # at most 65 of them
    stars = grouped.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter(F.col("a") < F.col("b"))
    return found.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint long, component_id) of every row.

    ``component_id`` is the least id reachable over links of at most two differing bits.
    Equal fingerprints are grouped first, with partial aggregation, so copies cost nothing
    further. Null or wordless texts share fingerprint zero and are linked like any other.
    Repeated ids stay separate rows, joined only by their fingerprints; a null id is kept as a
    row, and its group takes the least id that is not null (null if there is none).
    """
    rows = checkpoint(add_fingerprints(docs, id_col, text_col, width, seed))
    prints = checkpoint(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("first")))
    roots = connected_components(links_within_two(prints.select("fp")))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(groups, "fingerprint").select(id_col, "fingerprint", "component_id")


def tables_for(similarity: float, miss: float) -> int:
    """Tables of ``ROWS`` minima each in which a pair of that similarity meets nowhere with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**ROWS)))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """Least values of distinct shingle hashes under ``count`` linear maps; two sets agree in one with the probability of their Jaccard similarity."""
    rng = np.random.default_rng(count)
    factors, terms = (rng.integers(0, 2**32, count, dtype=np.uint32) for _ in range(2))
    factors |= np.uint32(1)
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(short), 512):
        least = np.minimum(least, (short[at : at + 512, None] * factors + terms).min(axis=0))
    return least


def add_minima(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, tables: int) -> DataFrame:
    """(id, text_hash, high, low, fp, keys, sketch) of every row: digest of the set of shingles, SimHash, a key for each table, the last byte of each minimum.

    A wordless text has fingerprint zero, and neither keys nor sketch.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys, sketches = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), width, seed)
                found = np.unique(hashes)
                prints.append(majority(hashes))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                least = minima(found, tables * ROWS) if len(found) else np.zeros(0, np.uint32)
                keys.append([xxhash.xxh64_intdigest(row.tobytes(), t) - 2**63 for t, row in enumerate(least.reshape(-1, ROWS))])
                sketches.append(least.astype(np.uint8).tobytes())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ], ["id", "text_hash", "high", "low", "fp", "keys", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, high bigint, low bigint, fp bigint, keys array<bigint>, sketch binary")


def simhash_candidates(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between sets (``n``, ``fp``) whose SimHash fingerprints differ in two bits at most, by the tables of ``links_within_two``.

    Sets of one fingerprint hang on the least of them, and those stand for it in the links between fingerprints.
    """
    first = checkpoint(prints.groupBy("fp").agg(F.min("n").alias("first")))
    equal = prints.join(first, "fp").filter("n > first").select(F.col("first").alias("a"), F.col("n").alias("b"))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"n_{name}"))
    near = links_within_two(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    return equal.unionByName(near)


def in_blocks(members: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows of every pair of blocks (``i``, ``j``) of a group, dealt and sorted by them; a row of block ``j`` has side 1 where ``i`` < ``j``.

    A group falls into ``size`` blocks, and each pair of blocks is work of its own, so no pair of a group is left out however large it is.
    """
    own = members.withColumn("blocks", F.greatest(size, F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    spread = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = spread.select(
        group, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"),
        *[c for c in members.columns if c != group],
    )
    return work.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def link_forest(names: list[int], side: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges with the components of all links of one pair of blocks; pairs that are connected already are not compared again."""
    label, edges, cross = np.arange(len(names)), [], bool(side.any())
    for x in np.flatnonzero(side == 0).tolist():
        open_ = label != label[x]
        if cross:
            open_ &= side == 1
        else:
            open_[:x] = False
        rest = np.flatnonzero(open_)
        if not len(rest):
            continue
        for y in rest[linked(x, rest)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                edges.append((names[x], names[y]))
    return edges


def forests(work: DataFrame, value: str, read: Callable, linker: Callable[[list], Callable]) -> DataFrame:
    """Edges (a, b) of every pair of blocks from ``in_blocks``; ``read`` makes an item of a value, ``linker`` compares items."""
    names = ["a", "b"]
    rows = work.select(work.columns[0], "i", "j", "side", "n", value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: list) -> pa.RecordBatch:
            found = link_forest([n for _, n, _ in held], np.array([s for s, _, _ in held]), linker([v for _, _, v in held])) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names)

        held, last = [], None
        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)
            for at, (group, side, n) in enumerate(zip(groups, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if group != last:
                    if len(held) > 1:
                        yield edges(held)
                    held, last = [], group
                held.append((side, n, read(batch.column(5)[at].as_py())))
        yield edges(held)

    return rows.mapInArrow(run, "a bigint, b bigint")


def shingle_linker(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the exact Jaccard similarity of a set with others is ``similarity`` or more."""
    sizes = np.array([len(s) for s in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marked = np.zeros(max((int(c.max()) for c in codes if len(c)), default=0) + 1, dtype=bool)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), dtype=bool)
        fit = np.flatnonzero(np.minimum(sizes[others], sizes[x]) >= similarity * np.maximum(sizes[others], sizes[x]) - 1e-9)
        marked[codes[x]] = True
        for at in range(0, len(fit), 64):
            some = fit[at : at + 64]
            ys = others[some]
            stops = np.cumsum(sizes[ys])
            common = np.add.reduceat(marked[np.concatenate([codes[y] for y in ys])].astype(np.int64), np.concatenate(([0], stops[:-1])))
            out[some] = common >= similarity * (sizes[ys] + sizes[x] - common) - 1e-9
        marked[codes[x]] = False
        return out

    return linked


def exact_links(candidates: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str, similarity: float, width: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect texts of an exact Jaccard similarity of ``similarity`` or more in distinct word shingles.

    ``candidates`` (a, b) only say what is compared: all pairs of a component of theirs are, by the texts themselves, in blocks.
    A family of near copies costs about as many comparisons as it has texts in each pair of blocks; G texts that are all a little
    less alike than ``similarity`` cost G squared, spread over all tasks.
    """
    roots = connected_components(candidates)
    wanted = checkpoint(prints.join(roots.withColumnRenamed("node", "n"), "n").select("n", "root", "text_hash"))
    # most texts are no candidates; a table of hashes alone is the likeliest to be small enough to leave the others where they are
    hashes = checkpoint(wanted.select("text_hash").distinct())
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text")).join(hashes, "text_hash", "left_semi").join(wanted, "text_hash")
    members = checkpoint(texts.groupBy("n").agg(F.first("root").alias("root"), F.first("text").alias("text")))
    sizes = checkpoint(members.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.length("text")).alias("chars")))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS))
    work = in_blocks(members.join(sizes, "root").select("root", "n", "text", "size", "chars"), "root", blocks)
    return forests(work, "text", lambda text: np.unique(shingle_hashes(text, width, seed)), lambda sets: shingle_linker(sets, similarity))


def distance_at(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which two texts count as that similar.

    Sets of equal size with Jaccard similarity s have the cosine 2s / (1 + s), and a bit differs with
    probability angle / pi. One standard deviation is allowed on top.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WORDS
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def sketch_linker(sketches: list[bytes], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether sketches agree in so many places as a pair of ``similarity`` does but for four standard deviations."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    least = rows.shape[1] * similarity - 4 * math.sqrt(rows.shape[1] * similarity * (1 - similarity))
    return lambda x, others: (rows[others] == rows[x]).sum(axis=1) >= least


def similar_groups(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, miss: float = 1e-3,
) -> DataFrame:
    """(id, component_id) of every row: groups of texts linked by an exact Jaccard similarity of ``similarity`` or more in distinct word shingles.

    Texts of the same set of shingles are grouped first. Sets whose SimHash fingerprints differ in two bits at most are candidates, as in ``near_duplicates``. They are
    only the nearest of the pairs at such a threshold, so the tables below find the rest. Every set keeps the minima of its shingles under random maps; six of them are
    the key of a table, and there are as many tables as make the chance that a pair right at the threshold meets in none ``miss`` at most
    (far less for nearer pairs). All entries of a bucket are compared by their sketches, in blocks, and a forest of what may be alike leaves the task. Candidates only say which texts ``exact_links`` compares.
    Nulls, repeated rows and ids are as in ``near_duplicates``.
    """
    rows = checkpoint(add_minima(docs, id_col, text_col, width, seed, tables_for(similarity, miss)))
    grouped = rows.groupBy("high", "low").agg(F.min("id").alias("first"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    prints = checkpoint(grouped.select(F.monotonically_increasing_id().alias("n"), "*"))
    entries = prints.select("n", F.explode("keys").alias("key"))
    sizes = checkpoint(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    met = entries.join(sizes, "key").join(prints.select("n", "sketch"), "n").select("key", "n", "sketch", "size")
    work = in_blocks(met, "key", F.ceil(F.col("size") / BUCKET_BLOCK))
    candidates = forests(work, "sketch", lambda sketch: sketch, lambda found: sketch_linker(found, similarity))
    candidates = candidates.unionByName(simhash_candidates(prints.select("n", "fp")))
    roots = connected_components(exact_links(candidates, prints, docs, text_col, similarity, width, seed))
    rooted = prints.join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(least, "root").select("high", "low", "component_id")
    return rows.select("id", "high", "low").join(groups, ["high", "low"]).select(F.col("id").alias(id_col), "component_id")
