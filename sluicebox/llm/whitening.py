"""Whitening of embeddings: exact sums of products from bit planes, and principal components of their covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, schema_of
from sluicebox.session import materialise

#: Entries are the whole part of so many times a component.
SCALE = 256
#: Rows whose bit planes are in memory at once; 64 rows are a word.
BLOCK_ROWS = 1 << 14
#: Sums are added up by Spark in limbs of so many bits, so that no sum of them leaves 64 bits.
LIMB_BITS = 31
#: An eigenvalue below this share of the largest one is no variance, but rounding.
LEAST_SHARE = 1e-12


def whole_entries(embedding: Column) -> Column:
    """The entries as whole numbers; beyond 64 bits the nearest such number. ``floor`` knows no negative zero."""
    return F.transform(embedding, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return embedding.isNotNull() & F.forall(F.transform(embedding, lambda c: c.cast("double")), finite)


def rows_of(column: pa.ListArray, size: int) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones with zeros at their end."""
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy()
    if (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = values
    return out


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The bits of each dimension's entries, 64 rows in a word, and dimension and weight of each plane.

    ``x`` is not negative. Planes without a bit are left out.
    """
    words = -(-len(x) // 64) * 8
    planes, names = [], []
    for d, column in enumerate(x.T):
        top = int(column.max()).bit_length() if len(column) else 0
        for b in range(top):
            bits = np.packbits((column >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little")
            planes.append(np.pad(bits, (0, words - len(bits))).view("<u8"))
            names.append((d, b))
    return np.array(planes, np.uint64).reshape(len(names), words // 8), names


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of the entries of each dimension, and of the products of each two dimensions.

    Each dimension is shifted by its least entry. The sum of products of two shifted dimensions is that of the common
    bits of each two of their planes, times the planes' weights; the shifts are put back at the end.
    """
    n, d = x.shape
    least = [int(v) for v in x.min(0)]
    shifted = np.subtract(x, x.min(0), dtype=np.int64).astype(np.uint64)  # wraps to the right unsigned number
    planes, names = bit_planes(shifted)
    of, weight = np.array([p[0] for p in names], np.int64), [p[1] for p in names]
    starts = np.searchsorted(of, np.arange(d + 1))
    common = np.zeros((len(names), len(names)), np.int64)
    for i in range(len(names)):
        common[i, i:] = np.bitwise_count(planes[i:] & planes[i]).sum(1, dtype=np.int64)
    common = np.triu(common) + np.triu(common, 1).T
    sums, squares = [0] * d, [[0] * d for _ in range(d)]
    # Counts are below 2**14, so that 2**49 times as much still is a whole number of 64 bits.
    small = max(weight, default=0) <= 22
    powers = np.array([1 << w for w in weight], np.int64 if small else object)
    weighted = common * powers[:, None] * powers[None, :] if small else common.astype(object) * powers[:, None] * powers
    ones = np.bitwise_count(planes).sum(1, dtype=np.int64) * powers
    for i in range(d):
        sums[i] = int(ones[starts[i] : starts[i + 1]].sum())
    for i in range(d):
        for j in range(i, d):
            u = int(weighted[starts[i] : starts[i + 1], starts[j] : starts[j + 1]].sum())
            squares[i][j] = squares[j][i] = u + least[i] * sums[j] + least[j] * sums[i] + n * least[i] * least[j]
    return [s + n * m for s, m in zip(sums, least)], squares


def limbs(value: int, count: int) -> list[int]:
    """A whole number as ``count`` limbs; the last one has the sign."""
    mask = (1 << LIMB_BITS) - 1
    return [value >> LIMB_BITS * i & mask for i in range(count - 1)] + [value >> LIMB_BITS * (count - 1)]


#: 62 bits for the rows, 2 * 64 for a product, and the sign.
LIMBS = 7


def added(rows: DataFrame, count: Callable[[np.ndarray], list], size: int, kind: str) -> list:
    """The sums over all rows of what ``count`` makes of a block: a task adds up its own, Spark those of the tasks.

    The driver gets these sums alone. Whole numbers are added as limbs.
    """
    whole = kind == "bigint"
    ddl = f"i int, limb int, x {kind}"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = count(rows_of(batch.column("X").slice(start, BLOCK_ROWS), size))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            cut = [limbs(v, LIMBS) for v in total] if whole else [[v] for v in total]
            made = [(i, k, v) for i, parts in enumerate(cut) for k, v in enumerate(parts)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*made), arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = map_batches(rows.select("X"), run, ddl).groupBy("i", "limb").agg(F.sum("x").alias("x")).collect()
    out = [0 if whole else 0.0] * (1 + max((row["i"] for row in found), default=-1))
    for row in found:
        out[row["i"]] += row["x"] << LIMB_BITS * row["limb"] if whole else row["x"]
    return out


class Whitening(NamedTuple):
    """Rows and sums of the fit list, unit components in rows by falling eigenvalue, eigenvalues and their whole sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def from_mean(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole distances from the whole part of the mean, and what of each sum that part leaves."""
        whole, rest = (np.array(part, object) for part in zip(*(divmod(s, self.n) for s in self.sums)))
        low, high = x.min(0).astype(object) - whole, x.max(0).astype(object) - whole
        if max(map(abs, (*low, *high))) < 1 << 62:
            return x - whole.astype(np.int64), rest
        return x.astype(object) - whole, rest

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` whitened components of vectors; one without variance is 0."""
        from_mean, rest = self.from_mean(x)
        centred = from_mean.astype(np.float64) - rest.astype(np.float64) / self.n
        values = self.values[:count]
        real = self.values[:count] > LEAST_SHARE * max(self.values[0], 0)
        root = np.sqrt(np.where(real, values, 1.0))
        return np.where(real, centred @ self.components[:count].T / root, 0.0)


def fit_whitening(distinct: DataFrame, size: int) -> Whitening:
    """Components of the exact covariance of vectors ``X``, each of which counts once."""

    def count(x: np.ndarray) -> list[int]:
        sums, squares = scatter(x)
        return [len(x), *sums, *(squares[i][j] for i in range(size) for j in range(i, size))]

    found = added(distinct, count, size, "bigint")
    n, sums, rest = found[0], found[1 : size + 1], iter(found[size + 1 :])
    covariance = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            # Whole numbers until here: the quotient is rounded once.
            covariance[i, j] = covariance[j, i] = (n * next(rest) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, vectors.T[order], np.maximum(values[order], 0), float(np.trace(covariance)))


def identity_error(distinct: DataFrame, fitted: Whitening, count: int) -> float:
    """The largest entry of the covariance of whitened vectors of the fit list minus the identity, without its sign.

    Components without variance do not take part.
    """
    size = fitted.components.shape[1]
    real = int((fitted.values[:count] > LEAST_SHARE * fitted.values[0]).sum())
    if not real:
        return 0.0

    def products(x: np.ndarray) -> list[float]:
        w = fitted.project(x, real)
        return [*w.sum(0).tolist(), *(w.T @ w).ravel().tolist()]

    found = np.array(added(distinct, products, size, "double")) / fitted.n
    mean, square = found[:real], found[real:].reshape(real, real)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(real)).max())


def deviations(x: np.ndarray, fitted: Whitening) -> list[int | None]:
    """The exact squared distance from the mean, times the square of n; None beyond 38 digits."""
    from_mean, rest = fitted.from_mean(x)
    far = fitted.n * (1 + max(abs(int(from_mean.min())), abs(int(from_mean.max()))))
    if from_mean.shape[1] * far * far < 1 << 63:
        return ((fitted.n * from_mean - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((fitted.n * from_mean.astype(object) - rest) ** 2).sum(1)
    return [v if v < 10**38 else None for v in exact]


def whiten(df: DataFrame, keep: list[str], count: int = 4, embedding: str = "embedding") -> DataFrame:
    """The columns ``keep`` of every usable vector, and for each of its first ``count`` components a row with
    ``component``, ``n``, ``deviation`` (decimal), ``whitened``, ``explained`` and ``identity_error``.

    Vectors that are null, or hold null or entries that are not finite, are left out. The fit list has each different
    vector of whole entries once; all statistics are over that list. Vectors shorter than the longest one count as if
    zeros followed. A component without variance, as all are if there is one vector only, has ``whitened`` and
    ``explained`` 0. Entries beyond 64 bits are the nearest number of 64 bits, a deviation beyond 38 digits is null.
    Repeated rows each come back, but count once; null keys are kept; a table without usable vectors gives no row.

    Memory: a block of rows with its bit planes, and for each two dimensions a sum.
    """
    names = [f"KEEP{i}" for i in range(len(keep))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    vectors = df.where(usable(F.col(embedding))).select(*kept, whole_entries(F.col(embedding)).alias("X"))
    distinct = materialise(vectors.select("X").distinct(), "vectors")
    size = distinct.agg(F.max(F.size("X"))).first()[0] or 0
    kinds = ", ".join(f"{n} {vectors.schema[n].dataType.simpleString()}" for n in names)
    made = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    ddl = f"{kinds}, {made}"
    if not size:
        return df.sparkSession.createDataFrame([], ddl).toDF(*keep, *(c.split()[0] for c in made.split(", ")))
    count = min(count, size)
    fitted = fit_whitening(distinct, size)
    error = identity_error(distinct, fitted, count)
    share = (fitted.values[:count] / fitted.trace if fitted.trace > 0 else np.zeros(count)).tolist()
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("X"), size)
            again = np.repeat(np.arange(len(x)), count)
            columns = [
                *(batch.column(n).take(pa.array(again)) for n in names),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(again), fitted.n)),
                pa.array(deviations(x, fitted), pa.decimal128(38, 0)).take(pa.array(again)),
                pa.array(fitted.project(x, count).ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(again), error)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(vectors, run, ddl).toDF(*keep, *(c.split()[0] for c in made.split(", ")))
