"""Whitening of vectors by the exact eigenvalues of their whole-number scatter.

Entries become whole numbers, so n, the sums and the sums of products of all rows are exact, and so is the scatter matrix
n * sum(x x') - sum(x) sum(x)' = n^2 * covariance, whatever the rows' common offset. Its characteristic polynomial is found
modulo primes, a task for a few of them, and put together by Chinese remainders; the largest roots are isolated and refined
without rounding, and each root's vector, found by inverse iteration with many digits, is a task of its own. The size of
all this depends on the dimension alone. Rows are read twice more: for the whitened covariance, and for the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import charpoly
from .vectors import EXACT, as_exact, matrix, usable, widened


@dataclass
class Whitening:
    """n rows, their sums by dimension, and for each component its eigenvalue, share of the trace, and projection / sqrt(eigenvalue)."""

    n: int
    sums: list[int]
    scale: float
    eigenvalues: list[float]
    explained: list[float]
    projections: np.ndarray
    identity_error: float


def _whole(column: pa.Array | pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) without the offset, which no covariance depends on."""
    return np.floor(scale * matrix(column))


def _moments(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: a partition's count (i = j = -1), sums (j = -1) and sums of products (i <= j) as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object)
        for b in batches:
            y = _whole(b.column(0), scale)
            if (more := y.shape[1] - len(sums)) > 0:
                sums, products = np.pad(sums, (0, more)), np.pad(products, ((0, more), (0, more)))
            y = widened(y, len(sums))
            n += len(y)
            largest = float(np.abs(y).max(initial=0.0))
            step = max(1, int(min(len(y), EXACT // max(1.0, largest * largest)))) if len(y) else 1
            for a in range(0, len(y), step):
                part = as_exact(y[a : a + step], largest * largest * step)
                total, square = part.sum(axis=0), part.T @ part
                sums = sums + (total if total.dtype == object else total.astype(np.int64).astype(object))
                products = products + (square if square.dtype == object else square.astype(np.int64).astype(object))
        if n:
            i, j = np.triu_indices(len(sums))
            values = [n, *sums, *products[i, j]]
            rows = [np.concatenate([[-1], np.arange(len(sums)), i]), np.concatenate([[-1], np.full(len(sums), -1), j])]
            text = pa.array([str(v) for v in values]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({"i": pa.array(rows[0].astype(np.int32)), "j": pa.array(rows[1].astype(np.int32)), "v": text})

    return run


def _residues(scatter: list[list[int]], moduli: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: numbers of primes -> the prime and the polynomial's coefficients modulo it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [moduli[k] for k in b.column(0).to_pylist()]
            if own:
                found = charpoly.modular_polynomials(scatter, own)
                yield pa.RecordBatch.from_pydict({"prime": pa.array(own, pa.int64()), "residues": pa.array(found.tolist(), pa.list_(pa.int64()))})

    return run


def _components(scatter: list[list[int]], poly: list[int], intervals: list[tuple[int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: numbers of isolated roots -> component, its root, its unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                number, low, power, many = intervals[k]
                root, vectors = charpoly.null_space(scatter, *charpoly.refined(poly, low, power, many), many)
                yield pa.RecordBatch.from_pydict({"component": pa.array(range(number, number + many), pa.int32()), "root": [str(root)] * many, "vector": pa.array(vectors, pa.list_(pa.float64()))})

    return run


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sum of x, exactly: as doubles where all are exact, else as Python's integers."""
    largest = n * float(np.abs(y).max(initial=0.0)) + max(map(abs, sums), default=0)
    if largest < EXACT:
        return n * y - np.array(sums, dtype=np.float64)
    return n * as_exact(y, float("inf")) - np.array(sums, dtype=object)


def _project(model: Whitening, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The centred rows (n times), and the whitened ones."""
    c = _centred(widened(_whole(column, model.scale), len(model.sums))[:, : len(model.sums)], model.n, model.sums)
    return c, (c / model.n).astype(np.float64) @ model.projections.T


def _spread(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: a partition's sums of products of whitened components (i <= j), and their sums (j = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.projections)
        sums, products, any_ = np.zeros(k), np.zeros((k, k)), False
        for b in batches:
            w = _project(model, b.column(0))[1]
            sums, products, any_ = sums + w.sum(axis=0), products + w.T @ w, True
        if any_:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.concatenate([np.arange(k), i]).astype(np.int32)), "j": pa.array(np.concatenate([np.full(k, -1), j]).astype(np.int32)), "v": np.concatenate([sums, products[i, j]])})

    return run


def _numbers(df: DataFrame, n: int) -> DataFrame:
    """0 .. n-1, one to a task where there are so many cores."""
    return df.sparkSession.range(0, n, 1, min(n, max(1, df.sparkSession.sparkContext.defaultParallelism)))


def fit(rows: DataFrame, vector: str = "embedding", components: int = 32, scale: float = 64.0) -> Whitening:
    """The whitening of all rows' vectors as whole numbers floor(scale * x), by their largest components.

    Rows of a null vector, and with a null or non-finite entry, take no part; shorter vectors end in zeros. There are as
    many components as asked for, or as eigenvalues above 0: none for an empty table or equal rows. Equal eigenvalues have
    vectors at right angles to each other.
    """
    x = rows.select(F.col(f"`{vector}`").alias("vector")).where(usable("vector"))
    # at most (d + 1) (d + 2) / 2 rows
    told = {(r["i"], r["j"]): int(r["v"]) for r in x.mapInArrow(_moments(scale), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n, d = told.get((-1, -1), 0), 1 + max((i for i, _ in told), default=-1)
    sums = [told.get((i, -1), 0) for i in range(d)]
    product = lambda i, j: told.get((min(i, j), max(i, j)), 0)
    scatter = [[n * product(i, j) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    none = Whitening(n, sums, scale, [], [], np.zeros((0, d)), 0.0)
    if not trace:
        return none
    moduli = charpoly.primes(charpoly.coefficient_bits(scatter))
    found = _numbers(rows, len(moduli)).mapInArrow(_residues(scatter, moduli), "prime bigint, residues array<bigint>").collect()
    poly = charpoly.remaindered(sorted((r["prime"], list(r["residues"])) for r in found))
    intervals = charpoly.isolated(poly, components)
    made = sorted(_numbers(rows, len(intervals)).mapInArrow(_components(scatter, poly, intervals), "component int, root string, vector array<double>").collect())[:components]
    # a root is n^2 times an eigenvalue
    values = [float(r["root"]) / n / n for r in made]
    projections = np.array([r["vector"] for r in made]) / np.sqrt(values)[:, None]
    model = Whitening(n, sums, scale, values, [float(r["root"]) / trace for r in made], projections, 0.0)
    seen = {(r["i"], r["j"]): r["v"] / n for r in x.mapInArrow(_spread(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    k = range(len(made))
    model.identity_error = max(abs(seen[i, j] - seen[i, -1] * seen[j, -1] - (i == j)) for i in k for j in k if i <= j)
    return model


def _whitened(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.projections)
        for b in batches:
            if not (k and b.num_rows):
                continue
            c, w = _project(model, b.column(1))
            if c.dtype != object and float(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 62:
                c = c.astype(np.int64)
                deviation = pa.array((c * c).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([str(sum(int(v) ** 2 for v in row)) for row in c]).cast(pa.decimal128(38, 0))
            each = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_pydict({
                "key": b.column(0).take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                "deviation": deviation.take(pa.array(each)),
                "whitened": w.ravel(),
                "explained": np.tile(model.explained, len(w)),
            })

    return run


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: the key, component (from 1, by falling eigenvalue), n, deviation (the exact square of n times
    the distance from the mean), whitened, explained, identity_error.

    Rows of a null vector, and with a null or non-finite entry, give no row; shorter vectors end in zeros, of longer ones than
    those of the fit the rest isn't looked at. Null and repeated keys are rows like others; other columns are ignored; an
    empty table, and a model without components, give an empty table.
    """
    x = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")).where(usable("vector"))
    kind = x.schema["key"].dataType.simpleString()
    out = x.mapInArrow(_whitened(model), f"key {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select(F.col("key").alias(key), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))
