"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from spanledger.llm.sampling import labelled_texts, remainder

WIDTH = 6
FILTERS = 16
CHUNK = 1024
#: Bytes convolved at once.
BLOCK = 1 << 18


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS): learned filters over one-hot bytes
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): weights of the mean and of the maximum over chunks
    shift: float


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end with WIDTH - 1 zero bytes after each, chunk starts, first chunk per text, window mask.

    A window starts at every byte of a text; chunk c of a text holds the windows that start in
    its bytes [c * CHUNK, (c + 1) * CHUNK), so windows overlap into the next chunk and none is missed.
    """
    pad = b"\0" * (WIDTH - 1)
    data = np.frombuffer(pad.join([*(t or b"\0" for t in texts), b""]), np.uint8)
    sizes = np.fromiter((max(1, len(t)) for t in texts), np.int64, len(texts))
    begin = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
    per = -(-sizes // CHUNK)
    first = np.cumsum(per) - per
    starts = np.repeat(begin, per) + CHUNK * (np.arange(per.sum()) - np.repeat(first, per))
    valid = np.ones(len(data), bool)
    ends = begin + sizes
    for k in range(WIDTH - 1):
        valid[ends + k] = False
    valid[begin[np.fromiter((not t for t in texts), bool, len(texts))]] = False
    return data, starts, first, valid


def _pairs(taps: np.ndarray) -> np.ndarray:
    """Responses of two adjacent taps for every pair of bytes: (WIDTH / 2, 65536, FILTERS)."""
    return np.stack([(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)])


def _convolve(data: np.ndarray, pairs: np.ndarray, valid: np.ndarray) -> np.ndarray:
    code = data[:-1].astype(np.int32) * 256 + data[1:]
    count = len(data) - WIDTH + 1
    out = pairs[0].take(code[:count], axis=0)
    for k in range(1, WIDTH // 2):
        out += pairs[k].take(code[2 * k : 2 * k + count], axis=0)
    out[~valid[:count]] = -np.inf
    return out


def _features(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    per = np.diff(np.append(first, len(pooled)))
    return np.concatenate((np.add.reduceat(pooled, first, axis=0) / per[:, None], np.maximum.reduceat(pooled, first, axis=0)), axis=1)


def _pool(network: Network, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    data, starts, first, valid = _layout(texts)
    best = np.maximum.reduceat(_convolve(data, pairs, valid), starts, axis=0)
    return _features(np.maximum(best + network.bias, 0), first)


def score_texts(network: Network, texts: list[bytes], pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability per whole text. Long texts are convolved in pieces of whole chunks, so memory stays bounded."""
    pairs = _pairs(network.taps) if pairs is None else pairs
    scores, group, held = np.zeros(len(texts)), [], 0

    def logistic(features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ network.out + network.shift, -60, 60)))

    def flush() -> None:
        if group:
            scores[group] = logistic(_pool(network, pairs, [texts[i] for i in group]))
            group.clear()

    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            scores[i] = logistic(_long(network, pairs, text)[None, :])[0]
            continue
        group.append(i)
        held += len(text)
        if held >= BLOCK:
            flush()
            held = 0
    flush()
    return scores


def _long(network: Network, pairs: np.ndarray, text: bytes) -> np.ndarray:
    total, top, count = np.zeros(FILTERS), np.zeros(FILTERS), 0
    for at in range(0, len(text), BLOCK):
        piece = text[at : at + BLOCK + WIDTH - 1]
        own = min(BLOCK, len(text) - at)
        data = np.frombuffer(piece + b"\0" * (own + WIDTH - 1 - len(piece)), np.uint8)
        best = np.maximum.reduceat(_convolve(data, pairs, np.ones(len(data), bool)), np.arange(0, own, CHUNK), axis=0)
        pooled = np.maximum(best + network.bias, 0)
        total, top, count = total + pooled.sum(axis=0), np.maximum(top, pooled.max(axis=0)), count + len(pooled)
    return np.concatenate((total / count, top))


def train(samples: list[tuple[bytes, int]], rates: tuple[float, float] | None = None, epochs: int = 14, batch: int = 32, least_steps: int = 500, seed: int = 5) -> Network | None:
    """Adam on the log loss; the gradient of a maximum goes to the one window that gave it.

    ``rates`` are the numbers of rows labelled 0 and 1 that the sample stands for; the intercept is moved
    from the sample's balance to theirs, so scores are probabilities over the corpus.
    """
    labels = {y for _, y in samples}
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-least_steps * batch // len(samples)))  # a small sample is gone over more often
    net = Network((rng.standard_normal((WIDTH, 256, FILTERS)) * 0.15).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32), 0.0)
    params = [net.taps, net.bias, net.out, np.zeros(1, np.float32)]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs if len(labels) == 2 else 0):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads = _gradients(net, float(params[3][0]), [samples[i][0] for i in rows], np.array([samples[i][1] for i in rows]))
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for p, m, s, g in zip(params, means, squares, grads, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    ones = sum(y for _, y in samples)
    zeros = len(samples) - ones
    net.shift = float(params[3][0])
    if len(labels) == 1:
        net.out[:], net.shift = 0, 4.0 if ones else -4.0
    elif rates:
        net.shift += math.log(rates[1] / rates[0]) - math.log(ones / zeros)
    return net


def _gradients(net: Network, shift: float, texts: list[bytes], gold: np.ndarray) -> list[np.ndarray]:
    data, starts, first, valid = _layout(texts)
    count = len(data) - WIDTH + 1
    conv = net.taps[0].take(data[:count], axis=0)
    for k in range(1, WIDTH):
        conv += net.taps[k].take(data[k : k + count], axis=0)
    conv[~valid[:count]] = -np.inf
    best = np.maximum.reduceat(conv, starts, axis=0)
    sizes = np.diff(np.append(starts, count))
    where, which = np.nonzero(conv == np.repeat(best, sizes, axis=0))
    chunk = np.repeat(np.arange(len(starts)), sizes)
    spot = np.zeros(best.shape, np.int64)
    spot[chunk[where], which] = where
    pooled = np.maximum(best + net.bias, 0)
    features = _features(pooled, first)
    error = 1 / (1 + np.exp(-np.clip(features @ net.out + shift, -60, 60))) - gold
    error = (error / len(gold)).astype(np.float32)
    out = features.T @ error + 1e-4 * net.out
    per = np.diff(np.append(first, len(starts)))
    back = np.repeat(error / per, per)[:, None] * net.out[:FILTERS]
    owner = np.repeat(np.arange(len(texts)), per)
    top = (pooled == features[owner, FILTERS:]).astype(np.float32)
    top /= np.add.reduceat(top, first, axis=0)[owner]  # equal chunks share the gradient of their maximum
    back = back + top * (error[owner][:, None] * net.out[FILTERS:])
    back *= pooled > 0
    taps = np.zeros_like(net.taps)
    columns = np.broadcast_to(np.arange(FILTERS), spot.shape)
    for k in range(WIDTH):
        np.add.at(taps[k], (data[spot + k], columns), back)
    return [taps, back.sum(axis=0), out.astype(np.float32), np.array([error.sum()], np.float32)]


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_label: int = 800, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """Train on at most ``per_label`` labelled texts of each class, by least hash among ids whose crc32 modulo 5 is not 0."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("id"), 5) != 0)).distinct()
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not counts:
        return None
    samples = labelled_texts(docs, marks, counts, per_label, 17, id_col, text_col)
    return train([(t.encode("utf-8", "replace"), y) for t, y in samples], (counts[0], counts[1]) if len(counts) == 2 else None)


def score_quality(docs: DataFrame, network: Network | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(row, quality_score, quality_kept) of every row over its whole text; ``row`` holds all its columns, whatever they are called.

    A null or empty text has no window and gets the score of an empty text. Without a model (no labelled row) the score is 0.5.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("binary").alias("bytes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(network.taps) if network else None
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            scores = score_texts(network, texts, pairs) if network else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(scores >= threshold)], ["row", "quality_score", "quality_kept"])

    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("quality_score", DoubleType()), StructField("quality_kept", BooleanType())]))
