"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.sampling import labelled_texts, remainder

#: Letters and numerals that are not decimal digits; only the letters among them make a text one of words.
WORD = re.compile(r"[^\W\d_]")
#: The words of ``words_of`` with their places.
TOKEN = re.compile(r"[a-z\x80-\U0010ffff]+")
BUCKETS = 1 << 18
#: Longest character n-gram; those that touch a word edge are the affix features.
GRAM = 4
#: Words whose scores one task keeps.
CACHE = 300_000
#: Words that one forward-backward pass holds.
PASS = 400_000
UNKNOWN = "und"


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affix and n-gram features of all words, end to end, and where each word starts.

    The words are laid out as one array of code points with an edge mark between them, so an
    n-gram that holds an edge mark is a prefix or suffix feature.
    """
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    edge = points == 10
    owner = np.cumsum(edge)  # the mark before a word and its letters belong to it
    hashes, owners = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    inner_edge = np.zeros(len(points), dtype=bool)
    for n in range(1, GRAM + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        # a gram may start or end at an edge, but none lies within it
        inside = ~inner_edge[:size]
        ok = inside & ~(edge[:size] & edge[n - 1 :]) if n > 1 else ~edge[:size]
        mixed = rolled ^ (rolled >> np.uint64(29))
        hashes.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)[ok])
        owners.append((owner[:size])[ok] - 1)
        grown = inner_edge[: size - 1] | edge[n - 1 : n - 1 + size - 1] if n > 1 else inner_edge[: size - 1]
        inner_edge = grown
    features, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return features[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (BUCKETS, labels)
    lexicon: dict[str, int]
    words: np.ndarray  # (lexicon, labels)
    moves: np.ndarray  # (labels, labels): learned transitions
    start: np.ndarray


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Emission scores (word, label) of distinct words."""
    features, starts = gram_features(words)
    scores = np.add.reduceat(model.grams[features], starts, axis=0)
    known = np.array([model.lexicon.get(w, -1) for w in words])
    scores[known >= 0] += model.words[known[known >= 0]]
    return scores


def marginals(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word by scaled forward-backward.

    ``scores`` holds the sequences end to end. They run side by side, longest first, in time-major
    order (labels, words): step t is one slice that holds word t of all sequences that have one.
    """
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    size = np.sort(lengths)[::-1]
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # sequences longer than t
    begin = np.cumsum(active) - active
    step = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = begin[step] + np.repeat(rank, lengths)
    emit = np.empty((scores.shape[1], len(scores)), np.float32)
    emit[:, place] = np.exp(scores - scores.max(axis=1, keepdims=True)).T + 1e-20
    moves = np.exp(model.moves - model.moves.max()).astype(np.float32)
    onward = np.ascontiguousarray(moves.T)
    forward = np.empty_like(emit)
    state = np.repeat(np.exp(model.start - model.start.max()).astype(np.float32)[:, None], int(active[0]), axis=1)
    for t, (n, at) in enumerate(zip(active.tolist(), begin.tolist(), strict=True)):
        state = state[:, :n] if t == 0 else onward @ state[:, :n]
        state = state * emit[:, at : at + n]
        state /= state.sum(axis=0)
        forward[:, at : at + n] = state
    after = np.ones_like(state)
    for n, at in zip(active[::-1].tolist(), begin[::-1].tolist(), strict=True):
        if after.shape[1] < n:
            grown = np.ones((len(moves), n), np.float32)
            grown[:, : after.shape[1]] = after
            after = grown
        forward[:, at : at + n] *= after
        after = moves @ (emit[:, at : at + n] * after)
        after /= after.sum(axis=0)
    forward /= forward.sum(axis=0)
    return forward[:, place].T


def train(samples: list[tuple[str, str]], epochs: int = 6, length: int = 40, words_per_text: int = 400, lexicon: int = 20_000, seed: int = 3) -> Model | None:
    """Fit the field on (text, label) rows.

    Sequences switch between texts of different labels every few words, as code-switched text
    does, and every word carries its text's label. AdaGrad on the sequence likelihood; the gradient is the
    difference of observed and expected features from forward-backward.
    """
    rng = np.random.default_rng(seed)
    pools: dict[str, list[str]] = {}
    for text, label in samples:
        found = [w.decode() for w in words_of(text or "")]
        at = int(rng.integers(0, max(1, len(found) - words_per_text + 1)))
        pools.setdefault(label, []).extend(found[at : at + words_per_text])
    pools = {k: v for k, v in sorted(pools.items()) if v}
    if not pools:
        return None
    labels = list(pools)
    counts = Counter(w for pool in pools.values() for w in pool)
    frequent = {w: i for i, (w, c) in enumerate(counts.most_common(lexicon)) if c > 1}
    known = {w: i for i, w in enumerate(counts)}
    features, starts = gram_features(list(known))
    stops = np.append(starts[1:], len(features))
    lex = np.array([frequent.get(w, -1) for w in known])
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k), np.float32), frequent, np.zeros((max(1, len(frequent)), k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    stream = [np.array([known[w] for w in pools[x]]) for x in labels]
    sums = [np.full_like(x, 1e-2) for x in (model.grams, model.words, model.moves)]
    total = max(256, min(10_000, sum(map(len, stream)) // length))
    for epoch in range(epochs):
        step = 0.5 / (1 + epoch)
        for _ in range(max(1, total // 256)):
            ids, gold = _switched(stream, length, 256, rng)
            flat, inverse = np.unique(ids.ravel(), return_inverse=True)
            spans = [np.arange(starts[i], stops[i]) for i in flat]
            rows = features[np.concatenate(spans)]
            cut = np.cumsum([0, *(len(s) for s in spans[:-1])])
            emit = np.add.reduceat(model.grams[rows], cut, axis=0)
            has = lex[flat] >= 0
            emit[has] += model.words[lex[flat][has]]
            expected, pairs = _expected(model, emit[inverse].reshape(*ids.shape, k))
            error = -expected.reshape(-1, k)
            error[np.arange(len(error)), gold.ravel()] += 1
            per_word = np.zeros((len(flat), k), np.float32)
            np.add.at(per_word, inverse, error)
            seen = np.zeros((k, k), np.float32)
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            grown = np.repeat(per_word, [len(s) for s in spans], axis=0)
            touched, place = np.unique(rows, return_inverse=True)
            gradient = np.stack([np.bincount(place, grown[:, c], len(touched)) for c in range(k)], axis=1) / len(ids)
            sums[0][touched] += gradient**2
            model.grams[touched] += step * gradient / np.sqrt(sums[0][touched])
            word_gradient = per_word[has] / len(ids)
            sums[1][lex[flat][has]] += word_gradient**2
            model.words[lex[flat][has]] += step * word_gradient / np.sqrt(sums[1][lex[flat][has]])
            move_gradient = (seen - pairs) / len(ids)
            sums[2] += move_gradient**2
            model.moves += step * 0.2 * move_gradient / np.sqrt(sums[2])
    return model


def _switched(stream: list[np.ndarray], length: int, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``length`` words whose label changes every 5 to 30 words."""
    ids, gold = np.empty((count, length), np.int64), np.empty((count, length), np.int64)
    for row in range(count):
        at = 0
        while at < length:
            label = int(rng.integers(len(stream)))
            run = min(int(rng.integers(5, 31)), length - at)
            begin = int(rng.integers(max(1, len(stream[label]) - run + 1)))
            piece = stream[label][begin : begin + run]
            ids[row, at : at + len(piece)], gold[row, at : at + len(piece)] = piece, label
            at += len(piece)
    return ids, gold


def _expected(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels per word and expected transitions of sequences of one length."""
    count, length, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    moves = np.exp(model.moves - model.moves.max())
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        state = (forward[:, t - 1] @ moves) * emit[:, t]
        forward[:, t] = state / state.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        state = (emit[:, t + 1] * backward[:, t + 1]) @ moves.T
        backward[:, t] = state / state.sum(axis=1, keepdims=True)
    single = forward * backward
    single /= single.sum(axis=2, keepdims=True)
    joint = np.zeros((k, k), np.float32)
    for t in range(length - 1):
        pair = forward[:, t, :, None] * moves * (emit[:, t + 1] * backward[:, t + 1])[:, None, :]
        joint += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return single, joint


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


#: Bytes of words: ASCII letters and everything beyond ASCII; the rest separates.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals such as a superscript two or a Roman eight are not."""
    return any(m.group().isalpha() for m in WORD.finditer(text))


def words_of(text: str) -> list[bytes]:
    """Lower-case words of a text in UTF-8; none unless the text has a letter."""
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split() if has_letter(text) else []


class Tagger:
    """Labels whole texts; keeps word scores between batches of a task."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.scores = model, _Numbers(), np.zeros((0, len(model.labels)), np.float32)

    def _lookup(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known, self.scores = _Numbers(), self.scores[:0]
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > len(self.scores):
            new = [w.decode() for w in list(self.known)[len(self.scores) :]]
            self.scores = np.concatenate((self.scores, word_scores(self.model, new).astype(np.float32)))
        return self.scores[numbers]

    def tag(self, texts: list[str | None], spans: bool = False) -> list[tuple[str, float, list]]:
        """(label, share of the words' letters it explains, runs) per text; ``und`` without letters."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        order = sorted((i for i, x in enumerate(texts) if x), key=lambda i: len(texts[i]))
        for i in order:
            words = words_of(texts[i])
            if not words:
                continue
            group.append((i, words))
            held += len(words)
            if held >= PASS:
                self._pass(group, texts, out, spans)
                group, held = [], 0
        if group:
            self._pass(group, texts, out, spans)
        return out

    def _pass(self, group, texts, out, spans) -> None:
        words = [w for _, ws in group for w in ws]
        lengths = np.array([len(ws) for _, ws in group])
        shares = marginals(self.model, self._lookup(words), lengths)
        letters = np.fromiter(map(len, words), np.float32, len(words))
        starts = np.cumsum(lengths) - lengths
        weight = np.add.reduceat(shares * letters[:, None], starts, axis=0)
        weight /= weight.sum(axis=1, keepdims=True)
        best = weight.argmax(axis=1)
        for row, (i, ws) in enumerate(group):
            runs = []
            if spans:
                picked = shares[starts[row] : starts[row] + len(ws)].argmax(axis=1)
                for match, label in zip(TOKEN.finditer(texts[i].lower()), picked, strict=True):
                    name = self.model.labels[label]
                    if runs and runs[-1][2] == name:
                        runs[-1][1] = match.end()
                    else:
                        runs.append([match.start(), match.end(), name])
            out[i] = (self.model.labels[best[row]], float(min(1.0, weight[row, best[row]])), runs)


def fit_language_model(docs: DataFrame, per_label: int = 200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Train on at most ``per_label`` texts per label, taken by least hash among rows not held out.

    Held out are ids whose crc32 modulo 3 is 1; rows without an id, text or label are not learned from. The label set is
    every label that the other rows have.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(F.col(id_col), 3) != 1))
    marks = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # a label set, not data
    return train(labelled_texts(rows, marks.distinct(), counts, per_label, 11, id_col, text_col)) if counts else None


def identify_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, lang_pred, score[, runs]) of every row.

    Every word of the whole text gets label probabilities from the field; the document's label is
    the one with the most letters, and the score its share. A null text, a text without a
    letter, or no model (no labelled row) gives ``und`` with score 0. Null and repeated ids and repeated rows get a row each, an empty table
    gives none, and other columns are not read. ``runs`` are the code-switched spans
    (start, end, lang) in characters of the lower-cased text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tags = tagger.tag(texts, spans) if tagger else [(UNKNOWN, 0.0, [])] * len(texts)
            columns = [batch.column(0), pa.array([t[0] for t in tags], pa.string()), pa.array([t[1] for t in tags], pa.float64())]
            names = ["id", "lang_pred", "score"]
            if spans:
                runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                columns.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in t[2]] for t in tags], runs))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind}, lang_pred string, score double" + (", runs array<struct<start:int,end:int,lang:string>>" if spans else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)
