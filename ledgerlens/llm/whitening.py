"""Embedding whitening from a bit-sliced, exact scatter matrix.

Entries become integers x = floor(SCALE * c) + OFFSET. The fit list holds every
distinct x vector once. Each task takes its vectors in blocks, shifts every
dimension by the block's smallest value and cuts what remains into bit planes: one
bit a vector, packed across the vectors into 64-bit words. For two dimensions the
sum of products is then the sum, over their planes p and q, of 2 ** (p + q) times
the popcount of the planes' AND: integers only. The shift is taken back by integer
algebra, tasks return their upper triangles, Spark adds them as decimals, and the
driver, which holds dimensions squared numbers whatever the rows, centres the sums
as integers, n * sum(x y) - sum(x) sum(y), before the one division that turns them
into the doubles ``eigh`` reads.

Defined results: a null vector, or one with null or non-finite entries, is left
out; vectors must have one length, those of another than the most frequent one
(of equally many: the longer) are left out; entries beyond 2 ** 53 / SCALE count as
that; components without variance (below rounding, as for a list of one vector or a
constant dimension) are not returned; repeated rows are returned each but fitted
once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import ship, store

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: vectors sliced at a time; a multiple of 64
BLOCK = 16_384
_LIMIT = float(1 << 53)


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the usable rows."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), c * SCALE))) + F.lit(OFFSET).cast("long"))
    return df.filter(v.isNotNull() & finite).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors less OFFSET, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - OFFSET


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes x words, dimension of each plane, its power of two) of unsigned values, vectors x dimensions."""
    rows, d = y.shape
    words, owner, power = [], [], []
    for j in range(d):
        for p in range(int(y[:, j].max()).bit_length()):
            bits = np.packbits(((y[:, j] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8))
            words.append(np.pad(bits, (0, -len(bits) % 8)).view(np.uint64))
            owner.append(j)
            power.append(p)
    return np.array(words, np.uint64).reshape(len(owner), -(-rows // 64)), np.array(owner, int), np.array(power, int)


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, sums of products) of a block of integer vectors, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    p, owner, power = planes((x - low).astype(np.uint64))
    common = np.zeros((len(p), len(p)), np.int64)
    for a in range(len(p)):
        common[a, a:] = np.bitwise_count(p[a] & p[a:]).sum(axis=1, dtype=np.int64)
    common += np.triu(common, 1).T
    top = int(power.max()) if len(power) else 0
    kind = np.int64 if 2 * top + n.bit_length() + 2 * int(top + 1).bit_length() < 62 else object
    weight = np.zeros((d, len(p)), kind)
    weight[owner, np.arange(len(p))] = [1 << int(k) for k in power]
    sums = (weight @ np.diagonal(common).astype(kind)).astype(object)
    products = (weight @ common.astype(kind) @ weight.T).astype(object)
    low = low.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return list(sums + n * low), products.tolist()


def _scatter_rows(d: int):
    """Per task: (i, j, s): the sum of products of dimensions i <= j; j = d the sum of i; i = j = d the number of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            x = matrix(b.column(0), d)
            for k in range(0, len(x), BLOCK):
                block = x[k:k + BLOCK]
                s, p = scatter(block)
                n, total, products = n + len(block), total + np.array(s, object), products + np.array(p, object)
        if n:
            i, j = np.triu_indices(d)
            numbers = [*products[i, j], *total, n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*i, *range(d), d], pa.int32()), pa.array([*j, *[d] * d, d], pa.int32()),
                 pa.array([int(v) for v in numbers], pa.decimal128(38, 0))], names=["i", "j", "s"])

    return run


@dataclass
class Whitening:
    """A fitted whitening; ``sums`` are those of x less OFFSET."""

    dimensions: int
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components, unit columns
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if self.dimensions * most * most < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def eigen(n: int, sums: list[int], products: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors, share of the trace) of the covariance, by falling eigenvalue."""
    d = len(sums)
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if d else 0
    held = min(held, components)
    vectors = vectors[:, :held]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(held)])  # the largest entry is positive
    return values[:held], vectors * sign, values[:held] / max(np.trace(cov), np.finfo(float).tiny)


def _fit_list(rows: DataFrame) -> tuple[int, DataFrame]:
    """(dimensions, the stored distinct vectors of that length)."""
    distinct = store(rows.select("x").distinct(), "whitening-fit-list")
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return d, distinct.filter(F.size("x") == d)


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    ship(df)
    d, vectors = _fit_list(quantised(df, id_col, vector_col))
    empty = Whitening(d, 0, [0] * d, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    if not d:
        return empty
    found = vectors.mapInArrow(_scatter_rows(d), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    total = {(r["i"], r["j"]): int(r["s"]) for r in found.collect()}  # dimensions squared, whatever the rows
    n, sums = total[d, d], [total[i, d] for i in range(d)]
    products = [[total[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    values, axes, explained = eigen(n, sums, products, components)
    model = Whitening(d, n, sums, values, axes, explained)
    model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    d, k = model.dimensions, len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.whitened(model.centred(matrix(b.column(0), d)))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                         names=["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened, explained): a row per usable input row and component.

    ``deviation`` is the sum over the dimensions of (n * x - sums) ** 2, exact.
    """
    d, k = model.dimensions, len(model.values)
    rows = quantised(df, id_col, vector_col)
    rows = rows.filter(F.size("x") == d)
    kind = T.StructType([rows.schema["id"], T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DecimalType(38, 0)),
                         T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not (k and d and len(b)):
                continue
            centred = model.centred(matrix(b.column(1), d))
            deviation = pa.array([int(v) for v in (centred * centred).sum(axis=1)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(b)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), deviation.take(each),
                 pa.array(model.whitened(centred).ravel()), pa.array(np.tile(model.explained, len(b)))], names=kind.names)

    return ship(rows).mapInArrow(run, kind)
