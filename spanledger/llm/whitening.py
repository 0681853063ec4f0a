"""Whitening of embeddings by polarisation: covariances as differences of exact variances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.session import checkpoint

#: A component counts where its share of the trace is above this.
LEAST = 1e-13
#: Values are held within 2**EDGE so that they fit a long; sums travel in limbs of LIMB bits.
EDGE = 62
LIMB, LIMBS = 40, 5
ROWS = 4096


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, x) of the rows whose vector holds numbers only, each entry c as the long floor(scale * c) + shift."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    edge = float(2**EDGE)
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c.cast("double") * scale))) + F.lit(shift).cast("bigint"))
    return vectors.filter(sound).select(F.col(id_col).alias("id"), whole.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _fits(bound: int, times: int) -> bool:
    return bound * bound * times < 2**63


def _bound(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def pair_squares(y: np.ndarray, totals: np.ndarray) -> None:
    """Add the sum of (y_i + y_j)**2 over all rows to ``totals[i, j]`` for i <= j, exactly; i = j holds the sum of y_i**2."""
    size = y.shape[1]
    y = y if _fits(2 * _bound(y), len(y)) else y.astype(object)
    for i in range(size):
        sums = y[:, i + 1 :] + y[:, i : i + 1]
        totals[i, i] += int((y[:, i] * y[:, i]).sum())
        totals[i, i + 1 :] += (sums * sums).sum(axis=0).astype(object)


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> list[list[int]]:
    """n**2 times the covariance matrix, in whole numbers, doubled.

    ``squares`` are sums of squares of values centred on whole numbers, ``rest`` what is left of their sums. The variance of a
    dimension or of the sum of two is n * square - rest**2 over n**2; var(i + j) - var(i) - var(j) is twice the covariance.
    """
    size = len(rest)
    single = [n * squares[i, i] - rest[i] ** 2 for i in range(size)]
    out = [[0] * size for _ in range(size)]
    for i in range(size):
        out[i][i] = 2 * single[i]
        for j in range(i + 1, size):
            out[i][j] = out[j][i] = n * squares[i, j] - (rest[i] + rest[j]) ** 2 - single[i] - single[j]
    return out


def components(doubled: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues in falling order, unit eigenvectors as columns (largest entry positive) and the trace."""
    matrix = np.array([[float(Fraction(v, 2 * n * n)) for v in row] for row in doubled])
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0), float(np.trace(matrix))


def fit_list(whole: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, dimensions and sums per dimension; vectors of the commonest length (the longest of equals) are the fit list."""
    sizes = whole.filter(F.size("x") > 0).groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return 0, 0, []
    places = whole.filter(F.size("x") == first["size"]).select(F.posexplode("x").alias("i", "v"))
    sums = {r["i"]: int(r["s"]) for r in places.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}  # one row per dimension
    return first["n"], first["size"], [sums[i] for i in range(first["size"])]


def sums_of_squares(whole: DataFrame, size: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of centred values for every dimension and every sum of two; partial sums per task, added up by Spark in limbs."""
    middle = np.array(centre, dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((size, size), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                pair_squares(_centred(_matrix(batch.column(0).slice(at, ROWS), size), middle), totals)
        cells = [(i, j) for i in range(size) for j in range(i, size) if totals[i, j]]
        limbs = [pa.array([totals[c] >> LIMB * k & (1 << LIMB) - 1 for c in cells], pa.int64()) for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)] + limbs, ["i", "j", *[f"q{k}" for k in range(LIMBS)]])

    fields = "i int, j int, " + ", ".join(f"q{k} bigint" for k in range(LIMBS))
    partial = whole.select("x").mapInArrow(run, fields)
    rows = partial.groupBy("i", "j").agg(*[F.sum(f"q{k}").alias(f"q{k}") for k in range(LIMBS)]).collect()  # one row per pair of dimensions
    found = {(r["i"], r["j"]): sum(r[f"q{k}"] << LIMB * k for k in range(LIMBS)) for r in rows}
    return {(i, j): found.get((i, j), 0) for i in range(size) for j in range(i, size)}


def _centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x less whole numbers, as longs where they fit."""
    if _bound(x) < 2**61 and max(map(abs, middle), default=0) < 2**61:
        return x - middle.astype(np.int64)
    return x.astype(object) - middle


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; null where it does not fit a long."""
    wide = _bound(y) * n + max(map(abs, rest), default=0)
    d = y * n - rest.astype(np.int64) if y.dtype != object and _fits(wide, max(1, y.shape[1])) else y.astype(object) * n - rest
    return [s if s < 2**63 else None for s in map(int, (d * d).sum(axis=1))]


def whitened_vectors(vectors: DataFrame, keep: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for every sound vector and each of the first ``keep`` components.

    Values are centred on the whole number nearest to their mean, and what is left of the mean is taken off exactly, so every
    covariance is a quotient of whole numbers rounded once. The driver holds sums per dimension and pair of dimensions
    only. ``identity_error`` is measured on the whitened rows by Spark's own covariances.

    Null vectors and vectors with a null or non-finite entry are left out; so are empty ones and those of another length than the
    commonest. Entries beyond 2**62 / 1024 count as that. A component without variance has a null ``whitened`` and no part in
    ``identity_error``. A deviation that does not fit a long is null. Null and repeated ids and equal rows
    are ordinary rows; an empty table gives none; other columns are not read.
    """
    whole = checkpoint(whole_vectors(vectors, id_col, vector_col))
    n, size, sums = fit_list(whole)
    kind = vectors.schema[id_col].dataType.simpleString()
    whole = whole.filter(F.size("x") == size) if n else whole.limit(0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    values, base, trace = components(covariance(n, rest, sums_of_squares(whole, size, centre)), n) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    keep = min(keep, size)
    alive = [bool(e > LEAST * trace) for e in values[:keep]]
    scaled = base[:, :keep] / np.sqrt(np.where(alive, values[:keep], 1.0))
    middle, left, offset = np.array(centre, dtype=object), np.array(rest, dtype=object), np.array([float(Fraction(r, n)) for r in rest])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _centred(_matrix(batch.column(1), size), middle)
            w = (y.astype(np.float64) - offset) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * keep), pa.array(w.ravel(), mask=np.tile(~np.array(alive), len(w))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(y, n, left), pa.int64()), lists], ["id", "deviation", "w"])

    done = checkpoint(whole.mapInArrow(run, f"id {kind}, deviation bigint, w array<double>"))
    pairs = [(i, j) for i in range(keep) for j in range(i, keep) if alive[i] and alive[j]]
    errors = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)) for i, j in pairs]
    error = max(done.agg(*errors).first()) if pairs else 0.0
    explained = F.array(*[F.lit(float(e / trace) if trace else 0.0) for e in values[:keep]]) if keep else F.array(F.lit(0.0))
    listed = done.select("id", "deviation", F.posexplode("w").alias("component", "whitened"))
    return listed.select(
        F.col("id").alias(id_col), (F.col("component") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("component")].alias("explained"), F.lit(float(error)).alias("identity_error"))
