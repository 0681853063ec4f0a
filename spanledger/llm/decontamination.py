"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.session import checkpoint

#: Words of one index segment (a document is never divided).
SEGMENT_WORDS = 250_000
#: Words of the test items that one pass over the index takes.
PASS_WORDS = 200_000

#: ASCII letters in lower case, digits and all bytes beyond ASCII make words; the rest separates.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Segment:
    """Postings of some documents: positions count on through the segment, with a gap of one after each document."""

    def __init__(self) -> None:
        self.terms, self.parts, self.starts, self.size = _Numbers(), [], [], 0

    def add(self, words: list[bytes]) -> None:
        self.starts.append(self.size)
        self.parts.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.size += len(words) + 1

    def columns(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Terms, posting counts, positions (as gaps within each term's list) and document starts."""
        numbers = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        lengths = np.array([len(p) for p in self.parts])
        places = np.arange(len(numbers), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(numbers, kind="stable")
        counts = np.bincount(numbers, minlength=len(self.terms)).astype(np.int32)
        places = places[order].astype(np.int32)
        gaps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
        firsts = (np.cumsum(counts) - counts)[counts > 0]
        gaps[firsts] = places[firsts]
        return b"\n".join(self.terms), counts.tobytes(), gaps.tobytes(), np.array(self.starts, np.int32).tobytes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the index of every word of every text to the shared folder and return it.

    Two kinds of rows: one per document (segment, ord, id, n_words), and one per segment with its
    terms, posting counts, positions and document starts. A segment holds whole documents of about ``segment_words``
    words, so a term that a third of all documents use is spread over as many segments as they fill.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        segment, ids, counts = _Segment(), [], []

        def rows() -> Iterator[pa.RecordBatch]:
            n = len(ids)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, kinds), pa.array(counts, pa.int64()), none, none, none, none,
            ], NAMES)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, kinds), pa.nulls(1, pa.int64()), *(pa.array([c], pa.binary()) for c in segment.columns())], NAMES)

        kinds = None
        for batch in batches:
            kinds = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                segment.add(words)
                ids.append(key.as_py())
                counts.append(len(words))
                if segment.size >= segment_words:
                    yield from rows()
                    segment, ids, counts, number = _Segment(), [], [], number + 1
        if ids:
            yield from rows()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return checkpoint(rows.mapInArrow(run, f"segment bigint, ord int, id {kind}, n_words bigint, terms binary, counts binary, gaps binary, starts binary"))


NAMES = ["segment", "ord", "id", "n_words", "terms", "counts", "gaps", "starts"]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Test items in blocks of bounded size; the driver holds one block at a time."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["text"]))
        if words:
            block.append((row["item"], words))
            held += len(words)
        if held >= PASS_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _lists(batch_row: dict, wanted: dict[bytes, int]) -> dict[bytes, np.ndarray]:
    """Positions of the wanted terms in one segment."""
    counts = np.frombuffer(batch_row["counts"], np.int32)
    gaps = np.frombuffer(batch_row["gaps"], np.int32)
    ends = np.cumsum(counts)
    return {term: gaps[ends[k] - counts[k] : ends[k]].cumsum() for k, term in enumerate(batch_row["terms"].split(b"\n")) if term in wanted and counts[k]}


def _starts(window: list[tuple[int, bytes]], lists: dict[bytes, np.ndarray], slop: int) -> np.ndarray:
    """Where a window occurs: offset-adjusted lists are intersected from its rarest term on.

    ``window`` holds (offset, term), rarest first. With a slop, each other term may stand that many words from its place.
    """
    offset, term = window[0]
    found = lists[term] - offset
    for offset, term in window[1:]:
        places = lists.get(term)
        if places is None:
            return found[:0]
        at = found + offset
        right = np.searchsorted(places, at - slop)
        near = places[np.minimum(right, len(places) - 1)]
        found = found[(near >= at - slop) & (near <= at + slop) & (right < len(places))]
        if not len(found):
            break
    return found


def phrase_matches(index: DataFrame, items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text", slop: int = 0, keep: int | None = None) -> DataFrame:
    """(segment, ord, item, start, stop) of every occurrence of a window of an item, in words of the document.

    Windows are ``width`` consecutive words; an item of fewer is one window. Occurrences of one item that overlap or
    touch are joined into one span. A block of items is sent to all segments, with the words of
    ``PASS_WORDS`` at most, and its terms are first counted over the whole index, so every intersection starts with the
    globally rarest terms. ``slop`` above 0 gives proximity matches: each term within that many
    words of its place, for the ``keep`` rarest terms of a window (all by default).
    """
    spark = index.sparkSession
    segments = index.filter("terms IS NOT NULL")
    found = None
    for block in _blocks(items, id_col, text_col):
        wanted = {w: 0 for _, words in block for w in words}
        totals = _term_counts(segments, wanted)
        plans: dict[bytes, list[tuple[str, int, list[tuple[int, bytes]]]]] = {}
        for item, words in block:
            size = min(width, len(words))
            for at in range(len(words) - size + 1):
                window = sorted(enumerate(words[at : at + size]), key=lambda x: (totals.get(x[1], 0), x[0]))[:keep]
                if all(w in totals for _, w in window):
                    plans.setdefault(window[0][1], []).append((item, size, window))
        spans = segments.select("segment", "terms", "counts", "gaps", "starts").mapInArrow(_searcher(plans, wanted, slop), "segment bigint, ord int, item string, start int, stop int")
        found = spans if found is None else found.unionByName(spans)
    return spark.createDataFrame([], "segment bigint, ord int, item string, start int, stop int") if found is None else found


def _term_counts(segments: DataFrame, wanted: dict[bytes, int]) -> dict[bytes, int]:
    """Postings per wanted term over the whole index; as many as a block of items has words at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[bytes, int] = {}
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                numbers = np.frombuffer(counts.as_py(), np.int32).tolist()
                for term, n in zip(terms.as_py().split(b"\n"), numbers, strict=False):
                    if term in wanted:
                        sums[term] = sums.get(term, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    rows = segments.select("terms", "counts").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in rows.collect()}


def _searcher(plans, wanted, slop):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lists = _lists(row, wanted)
                starts = np.frombuffer(row["starts"], np.int32)
                hits: dict[tuple[int, str], list[tuple[int, int]]] = {}
                for term in lists.keys() & plans.keys():
                    for item, size, window in plans[term]:
                        for at in _starts(window, lists, slop).tolist():
                            ord_ = int(np.searchsorted(starts, max(at, 0), side="right")) - 1
                            hits.setdefault((ord_, item), []).append((at - int(starts[ord_]), at - int(starts[ord_]) + size))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for (ord_, item), spans in sorted(hits.items()):
                    for start, stop in _joined(sorted(spans)):
                        for column, value in zip(out, (ord_, item, start, stop), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["segment"]] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                ], ["segment", "ord", "item", "start", "stop"])

    return run


def _joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    start, stop = spans[0]
    for a, b in spans[1:]:
        if a > stop:
            yield start, stop
            start, stop = a, b
        else:
            stop = max(stop, b)
    yield start, stop


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Repeated rows and ids are documents of their own (known by segment and place). A null or wordless text has no
    words and no hit; items without words match nothing, items of one id count once, and a null item id is the empty id.
    """
    index = build_index(docs, id_col, text_col, segment_words)
    matches = phrase_matches(index, items, width).groupBy("segment", "ord").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, acc.reach))).alias("n"), F.greatest(acc.reach, s.stop).alias("reach")),
        lambda acc: acc.n,
    )
    hits = matches.select("segment", "ord", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("listed"))
    rows = index.filter("ord IS NOT NULL").select("segment", "ord", "id", "n_words").join(hits, ["segment", "ord"], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
