"""SentencePiece encoding of the merge type with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of which a task keeps the segmentation without drops.
CACHE = 200_000
#: Symbols up to which words are segmented side by side in arrays; longer words use a heap.
SHORT = 48
#: Occurrences that are looked up together, words that are segmented together, and ids that are decoded together.
MANY, BLOCK, DECODED = 65_536, 4_096, 1 << 20
NEVER = 1 << 30
# Keyed hash of an occurrence and its drops: SplitMix64.
STEP, MIX_A, MIX_B, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


@dataclass
class Vocabulary:
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_at: list[int]  # id of each byte
    surface: np.ndarray  # bytes that the ids decode to, in a row
    surface_starts: np.ndarray
    surface_sizes: np.ndarray
    word: re.Pattern  # cuts texts where no piece can join the two sides


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a merge-type model file; read once by the driver, a few MB whatever the corpus."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, surface, bytes_at = {}, {}, [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            bytes_at[value] = i
            surface.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i):
            surface.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            surface.append(piece.replace(SPACE, " ").encode())
    sizes = np.array(list(map(len, surface)), np.int64)
    return Vocabulary(ids, scores, bytes_at, np.frombuffer(b"".join(surface), np.uint8), np.cumsum(sizes) - sizes, sizes, _word_pattern(ids))


def _word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Runs of letters and runs of other characters, each with the spaces before it.

    Cutting there loses no merge as long as no piece joins a letter with another character than a
    leading space; letters that some piece does join so count as other characters. Where that still leaves a joint, only spaces cut.
    """
    joint = re.compile(rf"[^\W\d_](?=[^{SPACE}])[\W\d_]|(?=[^{SPACE}])[\W\d_][^\W\d_]")
    odd = re.escape("".join(sorted({c for p in pieces if joint.search(p) for c in p if c.isalpha() or c.isnumeric() and not c.isdecimal()})))
    letter, other = rf"[^\W\d_{odd}]", rf"(?:(?!{SPACE})[\W\d_{odd}])"
    still = re.compile(f"{letter}{other}|{other}{letter}")
    if any(still.search(p) or SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _ranges(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _chars(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class Symbols:
    """Pieces and single characters by number, the ids that each is written as, and the pieces that two of them join to. Number 0 is nothing and joins with nothing."""

    def __init__(self, vocabulary: Vocabulary, costs: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.letters = np.zeros(0x110000, np.int32)  # number of each character
        self.starts, self.sizes, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        numbers: dict[str, int] = {}
        for symbol in chain.from_iterable((costs, sorted({c for piece in costs for c in piece}))):
            numbers.setdefault(symbol, len(numbers) + 1)
        self._add(list(numbers))
        pairs = {}
        for piece, cost in costs.items():
            for cut in range(1, len(piece)):
                left, right = numbers.get(piece[:cut]), numbers.get(piece[cut:])
                if left and right:
                    pairs[left << 32 | right] = (cost, numbers[piece])
        keys = np.array([0, *pairs], np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.pair_costs = np.array([NEVER, *(cost for cost, _ in pairs.values())], np.int32)[order]
        self.joined = np.array([0, *(number for _, number in pairs.values())], np.int32)[order]

    def _add(self, symbols: list[str]) -> None:
        written = [[self.vocabulary.ids[s]] if s in self.vocabulary.ids else [self.vocabulary.bytes_at[b] for b in s.encode("utf-8", "replace")] for s in symbols]
        sizes = np.array([len(w) for w in written], np.int64)
        single = np.array([len(s) == 1 for s in symbols], bool)
        self.letters[_chars([s for s in symbols if len(s) == 1])] = len(self.sizes) + np.flatnonzero(single)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.array(list(chain.from_iterable(written)), np.int32)])

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of the characters of all words in a row."""
        chars = _chars(words)
        numbers = self.letters[chars]
        if not numbers.all():
            self._add([chr(c) for c in np.unique(chars[numbers == 0]).tolist()])
            numbers = self.letters[chars]
        return numbers

    def offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and number of the piece of each two symbols; ``NEVER`` where they join to none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        at[self.pairs[at] != keys] = 0
        return self.pair_costs[at], self.joined[at]

    def written(self, symbols: np.ndarray) -> np.ndarray:
        return _ranges(self.pool, self.starts[symbols], self.sizes[symbols])


class Known(dict):
    """Numbers of the words that a task has met; new ones wait in ``new``, and words too long for arrays are -1."""

    def __init__(self) -> None:
        super().__init__({None: 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > SHORT:
            return -1
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes texts; each candidate merge of each occurrence of a word is dropped by a draw of its own.

    Draws are keyed by seed, text and place of the occurrence. As they are independent, the number of candidates taken before the next
    drop is geometric, and one hash gives it. Occurrences whose first drop comes after their last candidate share the word's segmentation,
    of which a task keeps what it has met; all others are segmented anew, many side by side. What is kept changes no result.
    """

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int) -> None:
        self.vocabulary, self.seed = vocabulary, seed
        self.scale = 1 / math.log1p(-rate) if 0 < rate < 1 else None
        self.always = rate >= 1
        self.word = vocabulary.word
        order = {score: n for n, score in enumerate(sorted(set(vocabulary.scores.values()), reverse=True))}
        self.costs = {piece: order[score] for piece, score in vocabulary.scores.items()}
        self.symbols = Symbols(vocabulary, self.costs)
        self._forget()

    def _forget(self) -> None:
        literal = np.array([self.vocabulary.bytes_at[b] for b in SPACE.encode()], np.int32)
        self.known = Known()
        # of each known word: where its characters and its ids stand, and the candidates taken without drops
        self.char_starts, self.lengths, self.chars = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.id_starts, self.id_sizes, self.ids = np.zeros(1, np.int64), np.array([len(literal)]), literal
        self.taken = np.zeros(1, np.int64)

    def encode(self, text: str, salt: int = 0) -> bytes:
        """Ids as 32-bit integers. The mark for spaces, where it stands in the text itself, becomes its three bytes."""
        return self.encode_all([text], [salt])[0].tobytes()

    def encode_all(self, texts: Iterable[str], salts: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        words: list[str | None] = []
        bounds: list[tuple[int, int]] = []  # key and number of words of the texts that wait

        def flush() -> None:
            counts = np.array([n for _, n in bounds], np.int64)
            bases = np.repeat(np.array([base for base, _ in bounds], np.uint64), counts)
            places = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            written = [np.zeros(1, np.int64)]
            for at in range(0, len(words), MANY):
                until = at + MANY
                keys = mixed((places[at:until] + 1).astype(np.uint64) * np.uint64(STEP) + bases[at:until])
                for new, kept in zip(self._encoded(words[at:until], keys), (parts, written), strict=True):
                    kept.append(new)
            ends = np.cumsum(np.concatenate(written))[np.concatenate([[0], np.cumsum(counts)])]
            sizes.extend(np.diff(ends).tolist())
            words.clear()
            bounds.clear()

        for text, salt in zip(texts, salts, strict=True):
            before = len(words)
            for k, stretch in enumerate(text.split(SPACE) if text else ()):
                if k:
                    words.append(None)
                words += self.word.findall((SPACE if k == 0 else "") + stretch.replace(" ", SPACE))
            bounds.append((xxhash.xxh64_intdigest((salt & MASK).to_bytes(8, "little"), self.seed), len(words) - before))
            if len(words) >= MANY:
                flush()
        flush()
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.array(sizes, np.int64)

    def _encoded(self, words: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the occurrences in a row, and how many each has."""
        if len(self.known) > CACHE:
            self._forget()
        numbers = np.array(list(map(self.known.__getitem__, words)), np.int64)
        self._learn()
        first = self._gaps(keys)
        starts, sizes = self.id_starts[numbers], self.id_sizes[numbers]
        pools = [self.ids]
        dropped = np.flatnonzero((first < self.taken[numbers]) & (numbers >= 0))
        if len(dropped):
            which = numbers[dropped]
            ids, sizes[dropped], _ = self._segmented(self.chars, self.char_starts[which], self.lengths[which], first[dropped], keys[dropped])
            starts[dropped] = len(self.ids) + np.cumsum(sizes[dropped]) - sizes[dropped]
            pools.append(ids)
        end = sum(map(len, pools))
        for at in np.flatnonzero(numbers < 0).tolist():
            ids = np.frombuffer(self._long(words[at], int(keys[at])), np.int32)
            starts[at], sizes[at] = end, len(ids)
            end += len(ids)
            pools.append(ids)
        return _ranges(np.concatenate(pools), starts, sizes), sizes

    def _learn(self) -> None:
        """Segment the new words without drops."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        lengths = np.array(list(map(len, new)), np.int64)
        starts = len(self.chars) + np.cumsum(lengths) - lengths
        self.chars = np.concatenate([self.chars, self.symbols.of(new)])
        ids, sizes, taken = self._segmented(self.chars, starts, lengths)
        self.char_starts, self.lengths = np.concatenate([self.char_starts, starts]), np.concatenate([self.lengths, lengths])
        self.id_starts = np.concatenate([self.id_starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.id_sizes, self.ids = np.concatenate([self.id_sizes, sizes]), np.concatenate([self.ids, ids])
        self.taken = np.concatenate([self.taken, taken])

    def _gaps(self, keys: np.ndarray, drop: np.ndarray | int = 0) -> np.ndarray:
        """Candidates taken between two drops, for each key."""
        if self.scale is None:
            return np.full(len(keys), 0 if self.always else NEVER)
        share = ((mixed(keys + np.uint64(STEP) * np.asarray(drop + 1).astype(np.uint64)) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
        return np.minimum(np.log(share) * self.scale, NEVER).astype(np.int64)

    def _drops(self, key: int) -> Iterator[int]:
        """The same for one key, one gap after the other."""
        return (int(self._gaps(np.array([key], np.uint64), drop)[0]) for drop in count())

    def _numbers(self, symbols: list[str]) -> bytes:
        ids, out = self.vocabulary.ids, array("i")
        for symbol in symbols:
            number = ids.get(symbol)
            if number is None:
                out.extend(self.vocabulary.bytes_at[b] for b in symbol.encode("utf-8", "replace"))
            else:
                out.append(number)
        return out.tobytes()

    def _short(self, word: str, key: int) -> bytes:
        keys = np.array([key], np.uint64)
        chars = self.symbols.of([word])
        return self._segmented(chars, np.zeros(1, np.int64), np.array([len(chars)]), self._gaps(keys), keys)[0].tobytes()

    def _long(self, word: str, key: int) -> bytes:
        return self._numbers(self._heaped(word, self._drops(key)))

    def _segmented(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in a row, how many each has, and the candidates taken; without keys nothing is dropped."""
        order = np.argsort(lengths, kind="stable")
        sizes, taken = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        parts = []
        for at in range(0, len(order), BLOCK):
            rows = order[at : at + BLOCK]
            width = int(lengths[rows[-1]])
            places = np.arange(width)[:, None]
            symbols = np.zeros((width + 1, len(rows)), np.int32)
            symbols[:-1] = np.where(places < lengths[rows], chars[np.minimum(starts[rows] + places, len(chars) - 1)], 0)
            taken[rows] = self._joined(symbols, *(() if keys is None else (first[rows], keys[rows])))
            left = symbols.T.ravel()
            sizes[rows] = self.symbols.sizes[symbols].sum(axis=0)
            parts.append(self.symbols.written(left[left != 0]))
        # back to the order of the words
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        at = np.zeros(len(order), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return _ranges(ids, at, sizes), sizes, taken

    def _joined(self, symbols: np.ndarray, first: np.ndarray | None = None, keys: np.ndarray | None = None) -> np.ndarray:
        """Merge the symbols of words in place, a word a column and a place a row, the last row empty; returns the candidates taken.

        Each round takes the cheapest candidate of every word, of equal ones the first, drops it or merges it, and renews its two neighbours.
        Places are counted through the whole array, so the one ``n`` further is the same word's next.
        """
        rows, n = symbols.shape
        last = (rows - 1) * n
        agenda, piece = np.full(symbols.shape, NEVER, np.int32), np.zeros(symbols.shape, np.int32)
        after = np.arange(n, n + symbols.size).reshape(symbols.shape)
        before = after - 2 * n
        before[0] = after[-1] = last + np.arange(n)
        symbols, agenda, piece, after, before = (x.reshape(-1) for x in (symbols, agenda, piece, after, before))
        taken = np.zeros(n, np.int64)
        drops = np.zeros(n, np.int64)
        gap = first.copy() if first is not None else None

        def renew(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            cost, piece[at] = self.symbols.offers(left, right)
            agenda[at] = np.where(cost == NEVER, NEVER, cost * 64 + at // n)

        renew(np.arange(last), symbols[:last], symbols[n:])
        while True:
            least = agenda.reshape(rows, n).min(axis=0)
            live = np.flatnonzero(least != NEVER)
            if not len(live):
                return taken
            taken[live] += 1
            here = (least[live] & 63) * np.int64(n) + live
            if gap is not None:
                left = gap[live]
                gone = left == 0
                gap[live] = left - 1
                if gone.any():
                    again = live[gone]
                    drops[again] += 1
                    gap[again] = self._gaps(keys[again], drops[again])
                    agenda[here[gone]] = NEVER
                    here = here[~gone]
            there, made = after[here], piece[here]
            following, previous = after[there], before[here]
            symbols[here], symbols[there] = made, 0
            agenda[there] = NEVER
            after[here] = following
            inner = following < last
            before[following[inner]] = here[inner]
            renew(np.concatenate([here, previous]), np.concatenate([made, symbols[previous]]), np.concatenate([symbols[following], made]))

    def _heaped(self, word: str, gaps: Iterator[int]) -> list[str]:
        """Symbols of a word of any length, of whose candidates those after ``gaps`` others are dropped: the agenda as a heap with links between the symbols."""
        costs = self.costs
        symbols: list[str | None] = list(word)
        taken, drop = 0, next(gaps)
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            piece = symbols[left] + symbols[right]
            if piece in costs:
                heapq.heappush(agenda, (costs[piece], left, right, piece))

        for at in range(size - 1):
            offer(at, at + 1)
        while agenda:
            cost, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            taken += 1
            if taken > drop:
                drop = taken + next(gaps)
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s is not None]


def decode(vocabulary: Vocabulary, ids: Sequence[int]) -> str:
    """The text of any segmentation; only the space that encoding puts in front is taken away."""
    ids = np.asarray(ids, np.int32)
    raw = b"".join(_ranges(vocabulary.surface, vocabulary.surface_starts[part], vocabulary.surface_sizes[part]).tobytes() for part in np.split(ids, range(DECODED, len(ids), DECODED)))
    return raw[1:].decode("utf-8", "replace") if raw.startswith(b" ") else raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, token_ids, n_tokens[, lossless]) of every row.

    Every occurrence of a word is segmented by draws of its own, keyed by seed, id and place of the word only, so a task that runs again gives the same; another seed gives
    another segmentation. A null text has null ids, an empty text none. With ``check`` the ids are
    decoded again and ``lossless`` says whether the text came back (null for null).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, rate, seed)
        names = ["id", "token_ids", "n_tokens", "lossless"][: 4 if check else 3]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                salts = [xxhash.xxh64_intdigest(str(key), seed) for key in part.column(0).to_pylist()]
                ids, sizes = encoder.encode_all([t or "" for t in texts], salts)
                ends, missing = np.concatenate([[0], np.cumsum(sizes)]), part.column(1).is_null()
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=missing)
                columns = [part.column(0), rows, pa.array(sizes, pa.int64(), mask=missing.to_numpy(zero_copy_only=False))]
                if check:
                    columns.append(pa.array([None if t is None else decode(vocabulary, ids[a:b]) == t for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist(), strict=False)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind}, token_ids array<int>, n_tokens bigint" + (", lossless boolean" if check else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of every encoded row; null ids give a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else decode(vocabulary, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "token_ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
