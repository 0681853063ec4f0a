"""Toxicity by gradient-boosted trees over dense lexical features, with isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.sampling import labelled_texts, remainder
from spanledger.llm.simhash import shingle_hashes

EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…"
# Look-alike characters of disguised letters, and second-person words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú tu ti usted ustedes vosotros os".split())
NEAR = 6
BINS = 64
FEATURES = (
    "log_words", "lexicon_density", "lexicon_hits", "strong_density", "strong_hits", "distinct_strong", "near_second_person", "second_person_rate",
    "clustered_hits", "capital_rate", "shouted_rate", "exclamation_rate", "punctuation_rate", "symbol_rate", "obfuscated_rate", "obfuscated_hits",
)


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


@dataclass
class Sample:
    """A labelled text with what the lexicon needs of it, computed once."""

    text: str
    label: int
    words: frozenset[str]
    sketch: int

    @classmethod
    def of(cls, text: str, label: int) -> Sample:
        least = min(shingle_hashes(text.encode("utf-8", "replace"), 5, 1), default=0)
        return cls(text, label, frozenset(words_of(text)) - {""}, int(least))


def learn_lexicon(samples: list[Sample], size: int = 400) -> tuple[dict[str, float], frozenset[str]]:
    """Words that more toxic than other texts hold, by the lower bound of their log odds; and the strong ones among them.

    The bound takes two standard errors off, so a rare word that toxic texts hold by chance doesn't become strong. Near
    copies count as one text (by the least hash of their shingles), so their words do not gain by being copied.
    """
    seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
    totals, met = [0, 0], set()
    for sample in samples:
        if (sample.label, sample.sketch) in met:
            continue
        met.add((sample.label, sample.sketch))
        totals[sample.label] += 1
        counts = seen[sample.label]
        for w in sample.words:
            counts[w] = counts.get(w, 0) + 1
    bound = {}
    for w, hits in seen[1].items():
        if hits >= max(3, totals[1] // 100):
            other = seen[0].get(w, 0)
            odds = math.log((hits + 0.5) / (totals[1] + 1)) - math.log((other + 0.5) / (totals[0] + 1))
            value = odds - 2 * math.sqrt(1 / (hits + 0.5) + 1 / (other + 0.5)) + math.sqrt(2)  # a word never seen elsewhere is not punished for that
            if value > 1.0:
                bound[w] = value
    top = sorted(bound, key=lambda w: (-bound[w], w))[:size]
    return {w: bound[w] for w in top}, frozenset(w for w in top if bound[w] >= 2.5)


def features_of(text: str, lexicon: dict[str, float], strong: frozenset[str]) -> list[float]:
    """The dense features of one whole text, in the order of ``FEATURES``."""
    raw = text.split()
    if not raw:
        return [0.0] * len(FEATURES)
    low = [w.strip(EDGES) for w in text.lower().split()]
    n = len(low)
    hits = [i for i, w in enumerate(low) if w in lexicon]
    hard = [i for i in hits if low[i] in strong]
    person = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0
    if hits and person:
        where = np.array(person)
        at = np.array(hard or hits)
        right = np.searchsorted(where, at)
        gap = np.minimum(np.abs(at - where[np.minimum(right, len(where) - 1)]), np.abs(at - where[np.maximum(right - 1, 0)]))
        near = int((gap <= NEAR).sum())
    clustered = sum(b - a <= 20 for a, b in zip(hard, hard[1:], strict=False))
    odd = [w for w in low if not w.isalpha() and any(c in "013457@$!|*" for c in w) and any(c.isalpha() for c in w)] if any(c in text for c in "013457@$|*") else []
    hidden = sum(w.translate(LOOKALIKES) in strong or _masked(w, strong) for w in odd)
    letters = sum(map(len, low)) or 1
    capitals = sum(map(str.isupper, raw))
    upper = len(text) - len(text.translate(_UPPER)) if text.isascii() else sum(c.isupper() for c in text)
    marks = text.count("!") + text.count("?")
    points = sum(text.count(c) for c in ".,;:'\"-")
    symbols = sum(text.count(c) for c in "#$%&*@^~|<>=+_")
    return [
        math.log1p(n), len(hits) / n, min(len(hits), 50), len(hard) / n, min(len(hard), 50), len({low[i] for i in hard}), near, len(person) / n,
        clustered, upper / letters, capitals / n, marks / n, points / n, symbols / n, len(odd) / n, hidden,
    ]


_UPPER = {c: None for c in range(65, 91)}


def _masked(word: str, strong: frozenset[str]) -> bool:
    """Whether a word with letters starred out, as in ``w*rd``, fits a strong word."""
    if "*" not in word.strip("*"):
        return False
    return any(len(s) == len(word) and all(a == b or a == "*" for a, b in zip(word, s, strict=True)) for s in strong)


@dataclass
class Booster:
    lexicon: dict[str, float]
    strong: frozenset[str]
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, cut and value of a complete tree, level by level
    base: float
    knots: np.ndarray
    levels: np.ndarray


def _bin(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1).astype(np.int64)


def _grow(binned, gradient, hessian, depth, least, penalty):
    """One complete tree of ``depth`` levels by histogram splits, with second-order gains."""
    nodes = np.zeros(len(binned), np.int64)
    features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
    width = binned.shape[1]
    for level in range(depth):
        base = 2**level - 1
        count = 2**level
        local = nodes - base
        best = np.full(count, 1e-6)
        for k in range(width):
            slot = local * (BINS + 1) + binned[:, k]
            g = np.bincount(slot, gradient, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
            h = np.bincount(slot, hessian, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
            whole_g, whole_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + penalty) + (whole_g - g) ** 2 / (whole_h - h + penalty) - whole_g**2 / (whole_h + penalty)
            gain[(h < least) | (whole_h - h < least)] = 0
            top = gain.argmax(axis=1)
            value = gain[np.arange(count), top]
            better = value > best
            features[base : base + count][better], cuts[base : base + count][better] = k, top[better]
            best = np.maximum(best, value)
        nodes = 2 * nodes + 1 + (binned[np.arange(len(binned)), features[nodes]] > cuts[nodes])
    leaf = nodes - (2**depth - 1)
    values = -np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, hessian, 2**depth) + penalty)
    return features, cuts, values


def _walk(trees, binned: np.ndarray) -> np.ndarray:
    total = np.zeros(len(binned))
    rows = np.arange(len(binned))
    for features, cuts, values in trees:
        nodes = np.zeros(len(binned), np.int64)
        while nodes.size and nodes[0] < len(features):
            nodes = 2 * nodes + 1 + (binned[rows, features[nodes]] > cuts[nodes])
        total += values[nodes - len(features)]
    return total


def _boost(binned, gold, weight, rounds, depth, rate):
    base = math.log(max(1e-6, (weight * gold).sum()) / max(1e-6, (weight * (1 - gold)).sum()))
    margin, trees = np.full(len(gold), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, weight * (p - gold), weight * p * (1 - p), depth, 1.0, 1.0)
        tree = (tree[0], tree[1], tree[2] * rate)
        trees.append(tree)
        margin += _walk([tree], binned)
    return base, trees


def isotonic(margin: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators fit: knots and non-decreasing levels, linear between them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first and last margin
    for x, y, w in zip(margin[order], gold[order], weight[order], strict=True):
        blocks.append([w, y, x, x])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            w2, y2, _, last = blocks.pop()
            block = blocks[-1]
            block[1] = (block[0] * block[1] + w2 * y2) / (block[0] + w2)
            block[0] += w2
            block[3] = last
    knots = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    levels = [b[1] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(knots), np.clip(np.array(levels), 0.0, 1.0)


def train(samples: list[tuple[str, int]], rates: tuple[float, float] | None = None, rounds: int = 60, depth: int = 3, folds: int = 3) -> Booster | None:
    """Lexicon, trees and calibration from (text, label) rows; calibration uses margins of trees that did not see the row.

    ``rates`` are the numbers of rows labelled 0 and 1 the sample stands for, used as weights. With one class only, that class's rate is the score.
    """
    if not samples:
        return None
    gold = np.array([y for _, y in samples], float)
    share = rates or (float((gold == 0).sum()), float((gold == 1).sum()))
    weight = np.where(gold == 1, share[1] / max(1, gold.sum()), share[0] / max(1, (1 - gold).sum()))
    weight = weight * len(gold) / weight.sum()
    if len(set(gold)) == 1:
        return Booster({}, frozenset(), [np.zeros(0)] * len(FEATURES), [], 0.0, np.array([0.0]), gold[:1])
    prepared = [Sample.of(t, y) for t, y in samples]
    fold = np.arange(len(samples)) % folds
    margins = np.zeros(len(samples))
    for k in range(folds):
        inside = [s for s, f in zip(prepared, fold, strict=True) if f != k]
        part = _fit(inside, weight[fold != k], rounds, depth)
        x = np.array([features_of(s.text, part.lexicon, part.strong) for s, f in zip(prepared, fold, strict=True) if f == k])
        if len(x):
            margins[fold == k] = part.base + _walk(part.trees, _bin(x, part.cuts))
    model = _fit(prepared, weight, rounds, depth)
    model.knots, model.levels = isotonic(margins, gold, weight)
    return model


def _fit(samples: list[Sample], weight, rounds, depth, folds: int = 3) -> Booster:
    """Trees on features whose lexicon did not see the row (one lexicon per fold), and the lexicon of all rows for scoring."""
    x = np.zeros((len(samples), len(FEATURES)))
    for k in range(folds):
        own = learn_lexicon([s for i, s in enumerate(samples) if i % folds != k])
        for i in range(k, len(samples), folds):
            x[i] = features_of(samples[i].text, *own)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    base, trees = _boost(_bin(x, cuts), np.array([s.label for s in samples], float), weight, rounds, depth, 0.15)
    return Booster(*learn_lexicon(samples), cuts, trees, base, np.array([0.0]), np.array([0.5]))


def score_texts(model: Booster, texts: list[str]) -> np.ndarray:
    x = np.array([features_of(t, model.lexicon, model.strong) for t in texts]).reshape(len(texts), len(FEATURES))
    margin = model.base + _walk(model.trees, _bin(x, model.cuts))
    return np.interp(margin, model.knots, model.levels)


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, per_label: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Booster | None:
    """Train on at most ``per_label`` labelled texts of each class, by least hash among ids whose crc32 modulo 3 is not 1."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("id"), 3) != 1)).distinct()
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not counts:
        return None
    samples = labelled_texts(docs, marks, counts, per_label, 23, id_col, text_col)
    return train(samples, (counts[0], counts[1]) if len(counts) == 2 else None)


def score_toxicity(docs: DataFrame, model: Booster | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row over its whole text; null texts count as empty, and no model gives 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            scores = score_texts(model, texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
