"""Alignment of two tokenizers' tokens by byte ranges, for byte-level and piece vocabularies."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.session import checkpoint

FOLDER = "/opt/tokenizers"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SPACE = "▁"
#: Texts, or letters, tokenised and aligned at once; windows a task remembers, and their linked pairs on average.
BATCH = 256
LETTERS = 500_000
MEMO = 150_000
PAIRS = 8
#: A pair in more than 1/FREQUENT of all (document, pair) rows is frequent; there are fewer than FREQUENT of those.
FREQUENT = 50_000
STRETCH = 1 << 20


# Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else list(merge)


def _byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """The two vocabularies, opened in each task from ``folder``; only the paths travel with a job."""

    def __init__(self, folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> None:
        self.byte_level, self.pieces = os.path.join(folder, byte_level), os.path.join(folder, pieces)

    def __reduce__(self):
        return _reopened, (self.byte_level, self.pieces)

    @cached_property
    def first(self):
        """The byte-level vocabulary in the faster of the two libraries that read it; a merge's rank there is its id, which is checked."""
        import tiktoken

        ids = self.first_ids
        ranks = {token: i for i, token in enumerate(self.first_bytes) if i in ids}
        merged = [a + b for a, b in map(_pair, self.first_spec["merges"])]
        letters = len(ranks) - len(merged)
        if [self.first_spec["vocab"][m] for m in merged] != list(range(letters, len(ranks))):
            raise ValueError(f"merges of {self.byte_level} are not in order of their ids")
        return tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def first_spec(self) -> dict:
        with open(self.byte_level, encoding="utf-8") as file:
            return json.load(file)["model"]

    @cached_property
    def first_ids(self) -> set[int]:
        """Ids whose entry is written in letters for bytes; the others are special."""
        letters = _byte_letters()
        made = {"".join(_pair(m)) for m in self.first_spec["merges"]}
        return {i for token, i in self.first_spec["vocab"].items() if token in made or (len(token) == 1 and token in letters)}

    @cached_property
    def second(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.pieces)

    @cached_property
    def first_bytes(self) -> list[bytes]:
        letters, vocabulary = _byte_letters(), self.first_spec["vocab"]
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in token)
        return table

    @cached_property
    def second_bytes(self) -> list[bytes]:
        model = self.second
        return [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(model.get_piece_size())
        ]

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """Byte lengths of both, and which tokens begin with a space."""
        return tuple(np.array([f(t) for t in table]) for f in (len, lambda t: t[:1] == b" ") for table in (self.first_bytes, self.second_bytes))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for each text; none where either does not give back the bytes of a space and the text."""
        right = self.second.encode(texts, num_threads=1)
        for text, b in zip(texts, right, strict=True):
            a, raw = self.first.encode_ordinary(" " + text), (" " + text).encode()
            same = text and b"".join(map(self.first_bytes.__getitem__, a)) == raw and b"".join(map(self.second_bytes.__getitem__, b)) == raw
            yield (np.array(a, np.int32), np.array(b, np.int32)) if same else None


def _reopened(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers("", byte_level, pieces)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of the stretches of these lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values[np.repeat(starts, lengths) + _places(lengths)]


class Aligner:
    """Cuts documents at whitespace anchors and aligns each distinct window once.

    An anchor is a byte offset at which tokens of both sides end and the next token of both begins with a space. What lies between
    two anchors depends on its ids alone, so window alignments are kept by their id tuples: text of the groups, number of groups, and linked pairs, end to end in
    one array. New windows of a batch are aligned together. The memo is emptied between batches when full, which changes no result.
    """

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        numbers = [str(i).encode() for i in range(max(map(len, tokenizers.tables)))]
        self.digits = np.array([len(n) for n in numbers])
        self.letters = np.frombuffer(b"".join(n.ljust(8) for n in numbers), np.uint8).reshape(-1, 8)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[bytes] = []
        self.groups = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, and the ends, in tokens of either side. Every document begins with a space, so documents laid end to end never share a window."""
        a_size, b_size, a_space, b_space = self.tokenizers.tables
        a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        at = np.searchsorted(b_ends, a_ends)
        last = np.flatnonzero((b_ends[at] == a_ends)[:-1] & a_space[a[1:]])
        last = last[b_space[b[at[last] + 1]]]
        return np.concatenate([[0], last + 1, [len(a)]]), np.concatenate([[0], at[last] + 1, [len(b)]])

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number in the memo of every window in order, and where the windows begin in tokens of the first side."""
        a_cuts, b_cuts = self.cuts(a, b)
        sides = [(ids, cuts[:-1], np.diff(cuts)) for ids, cuts in ((a, a_cuts), (b, b_cuts))]
        same, first = self._distinct(sides)
        a_raw, b_raw = a.tobytes(), b.tobytes()
        edges = [(c[k] * 4).tolist() for c in (a_cuts, b_cuts) for k in (first, first + 1)]
        keys = [(a_raw[i:j], b_raw[m:n]) for i, j, m, n in zip(*edges)]
        known = list(map(self.memo.get, keys))
        new = [k for k, number in enumerate(known) if number is None]
        if new:
            self._add([(ids, starts[first[new]], lengths[first[new]]) for ids, starts, lengths in sides])
            for number, k in enumerate(new, len(self.memo)):
                known[k] = self.memo[keys[k]] = number
        return np.array(known, np.int64)[same], a_cuts[:-1]

    @staticmethod
    def _distinct(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the number of its like, and a window for each number: equal hashes, and then equal ids."""
        total = np.zeros(len(sides[0][1]), np.uint64)
        for side, (ids, starts, lengths) in enumerate(sides):
            place = _places(lengths).astype(np.uint64) * np.uint64(2) + np.uint64(side)
            total += np.add.reduceat(_mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED03)), starts)
        _, first, same = np.unique(total, return_index=True, return_inverse=True)
        alike = first[same]
        for ids, starts, lengths in sides:
            if not (np.array_equal(lengths[alike], lengths) and np.array_equal(_gathered(ids, starts[alike], lengths), ids)):
                return np.arange(len(total)), np.arange(len(total))
        return same, first

    def _add(self, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Align windows given by where they start and how long they are on either side, and append them."""
        (a, a_length), (b, b_length) = ((_gathered(ids, starts, lengths), lengths) for ids, starts, lengths in sides)
        a_ends, b_ends = np.cumsum(self.tokenizers.tables[0][a]), np.cumsum(self.tokenizers.tables[1][b])
        a_shared = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends
        b_shared = a_ends[np.searchsorted(a_ends, b_ends)] == b_ends
        # bytes between two ends of either side belong to one token of each, which are so linked
        ends = np.union1d(a_ends, b_ends)
        pairs = a[np.searchsorted(a_ends, ends)].astype(np.int64) << 32 | b[np.searchsorted(b_ends, ends)]
        window_ends = a_ends[np.cumsum(a_length) - 1]
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.searchsorted(ends, window_ends, "right")])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.groups = np.concatenate([self.groups, np.add.reduceat(a_shared.astype(np.int64), np.cumsum(a_length) - a_length)])
        # tokens in order of group and side, each with the sign that follows it
        order = np.concatenate([2 * (np.cumsum(a_shared) - a_shared), 2 * (np.cumsum(b_shared) - b_shared) + 1])
        by = np.argsort(order, kind="stable")
        ids, order = np.concatenate([a, b])[by], order[by]
        closes = np.append(order[1:] != order[:-1], True)
        sign = np.where(closes, np.where(order % 2 == 0, ord("|"), ord(";")), ord(","))
        width = self.digits[ids]
        stop = np.cumsum(width + 1)
        text = np.empty(int(stop[-1]), np.uint8)
        text[stop - 1] = sign
        for digit in range(int(width.max())):
            longer = np.flatnonzero(width > digit)
            text[stop[longer] - 1 - width[longer] + digit] = self.letters[ids[longer], digit]
        raw, at = text.tobytes(), [0, *stop[np.cumsum(a_length + b_length) - 1].tolist()]
        self.texts += [raw[i : j - 1] for i, j in zip(at, at[1:])]

    def documents(self, encoded: list[tuple[np.ndarray, np.ndarray] | None]) -> list[tuple]:
        """For each document n_a, n_b, n_groups, n_links, digest of the groups, and the distinct ids of linked pairs with how many links hold each."""
        if len(self.memo) > MEMO or len(self.pairs) > MEMO * PAIRS:
            self._forget()
        sound = [ids for ids in encoded if ids is not None]
        if not sound:
            return [_EMPTY] * len(encoded)
        a, b = (np.concatenate([ids[side] for ids in sound]) for side in (0, 1))
        numbers, begins = self.windows(a, b)
        edges = np.searchsorted(begins, np.cumsum([0, *(len(ids[0]) for ids in sound)])).tolist()
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        pairs, links = _gathered(self.pairs, self.starts[numbers], lengths), np.concatenate([[0], np.cumsum(lengths)])
        listed, rows = numbers.tolist(), []
        for (left, right), low, high in zip(sound, edges, edges[1:], strict=False):
            digest = hashlib.sha256()
            for at in range(low, high, STRETCH):
                digest.update((b";" if at > low else b"") + b";".join([self.texts[n] for n in listed[at : min(high, at + STRETCH)]]))
            found, times = np.unique(pairs[links[low] : links[high]], return_counts=True)
            groups = int(self.groups[numbers[low:high]].sum())
            rows.append((len(left), len(right), groups, int(links[high] - links[low]), digest.hexdigest(), (found >> 32).astype(np.int32), found.astype(np.int32), times.astype(np.int32)))
        filled = iter(rows)
        return [_EMPTY if ids is None else next(filled) for ids in encoded]


_NONE = np.zeros(0, np.int32)
_EMPTY = (0, 0, 0, 0, "", _NONE, _NONE, _NONE)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are tokenised and aligned together."""
    low = size = 0
    for at, text in enumerate(texts):
        if at > low and (at - low >= BATCH or size > LETTERS):
            yield low, at
            low, size = at, 0
        size += len(text or "")
    if low < len(texts):
        yield low, len(texts)


def align_documents(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every row; ``pairs`` is an array of (a, b, times).

    Texts are tokenised whole and checked byte by byte; a text that is null or empty, or that either tokenizer does not give back, has no tokens.
    """
    tokenizers = tokenizers or Tokenizers()
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _batches(texts):
                part = batch.slice(low, high - low)
                rows = aligner.documents(list(tokenizers.encode([t or "" for t in texts[low:high]])))
                ends = np.cumsum([0] + [len(r[5]) for r in rows]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([r[c] for r in rows])) for c in (5, 6, 7)], fields=list(shape.value_type))
                counts = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([r[4] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat, type=shape)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    fields = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<a:int,b:int,times:int>>"
    aligned = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields)
    return aligned.withColumn("row", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, rows, best): how many links of the corpus hold an id pair, in how many documents, and whether no pair of its ``b`` has more."""
    one = F.col("pair")
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy(one.a.alias("a"), one.b.alias("b")).agg(F.sum(one.times).alias("links"), F.count("*").alias("rows"))
    counted = checkpoint(counted)
    highest = counted.groupBy("b").agg(F.max("links").alias("highest"))
    return counted.join(highest, "b").select("a", "b", "links", "rows", (F.col("links") == F.col("highest")).alias("best"))


def token_alignment(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A task hands on each distinct pair of a document once. Pairs that make up more than 1/FREQUENT of these rows are
    fewer than FREQUENT whatever the corpus, so their counts are broadcast; the rows of all other pairs, none of
    which is frequent, meet their counts in a shuffle. Null and repeated ids and equal rows are rows of their own (rows are told apart by
    ``row``), an empty table gives none, and other columns are not read.
    """
    aligned = checkpoint(align_documents(docs, tokenizers, id_col, text_col))
    counts = checkpoint(pair_counts(aligned))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_frequent = F.col("rows") * FREQUENT > F.lit(total)
    value = F.struct("links", "best").alias("value")
    listed = aligned.select("row", F.explode("pairs").alias("pair")).select("row", "pair.*")
    sums = [F.sum(F.col("times") * F.col("value.links")).alias("count_sum"), F.sum(F.when(F.col("value.best"), F.col("times"))).alias("n_best")]
    near = listed.join(F.broadcast(counts.filter(is_frequent).select("a", "b", value)), ["a", "b"])
    far = listed.join(F.broadcast(counts.filter(is_frequent).select("a", "b")), ["a", "b"], "left_anti").join(counts.filter(~is_frequent).select("a", "b", value), ["a", "b"])
    summed = near.groupBy("row").agg(*sums).unionByName(far.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs").join(summed, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
