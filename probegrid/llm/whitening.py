"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, floor(1024 * entry) + 100000, and are written once as
blocks of rows. Their sums are exact. The leading eigenvectors of the
covariance V come from a small block Q of columns: one pass over the blocks
gives V Q = X'X Q / n of the centred rows, summed per task and then by Spark, so
that V itself is never formed and the driver holds no more than columns of one
vector's length. Each round applies a Chebyshev polynomial in V that damps what
lies below the block's own smallest Ritz value, orthonormalises by QR, and takes
Rayleigh-Ritz pairs. It ends when the residuals of all wanted pairs are at
rounding level. A Lanczos probe rides along as one more column of the passes:
its Ritz values bound the unwanted part of the spectrum from below.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import stored

SCALE, SHIFT = 1024, 100000
KEEP = 8
#: Residuals of wanted pairs, relative to the largest eigenvalue, that count as converged.
TOLERANCE = 1e-13
#: Residuals that have stopped falling are accepted below this.
ROUNDING = 1e-11
DEGREE = 10
ROUNDS = 60
#: Entries of a written block, at most: 8 MB in memory.
BLOCK = 1 << 20
#: Entries beyond this cannot be held as long with room for a difference.
LARGEST = 2.0 ** 61
PAIRS = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact decimal(38,0)"


def _blocks(vectors: DataFrame) -> DataFrame:
    """``dim, size, ids, x``: usable rows of one length, their integers row by row as little-endian binary."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            entries = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf) if len(values) else np.empty(0)
            lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            whole = np.floor(entries * SCALE)
            fine = np.abs(whole) < LARGEST
            bad = np.concatenate([[0], np.cumsum(~fine)])
            usable = (lengths > 0) & (bad[starts + lengths] == bad[starts])
            for dim in np.unique(lengths[usable]):
                rows = np.flatnonzero(usable & (lengths == dim))
                step = max(1, BLOCK // int(dim))
                for at in range(0, len(rows), step):
                    part = rows[at:at + step]
                    x = whole[starts[part][:, None] + np.arange(dim)].astype(np.int64) + SHIFT
                    small = np.abs(x).max() < 2 ** 31
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(dim)], pa.int32()), pa.array([len(part)], pa.int64()),
                        pa.array([batch.column(0).take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                    ], names=["dim", "size", "ids", "x"])

    return vectors.mapInArrow(convert, "dim int, size long, ids array<long>, x binary")


def _rows(x: pa.Scalar, size: int, dim: int) -> np.ndarray:
    """The integers of a block, as int64."""
    raw = x.as_buffer()
    return np.frombuffer(raw, dtype="<i4" if raw.size == 4 * size * dim else "<i8").reshape(size, dim).astype(np.int64)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, however large."""
    step = max(1, 2 ** 62 // max(1, int(np.abs(x).max(initial=0))))
    total = [0] * x.shape[1]
    for at in range(0, len(x), step):
        total = [t + int(s) for t, s in zip(total, x[at:at + step].sum(axis=0), strict=True)]
    return total


def _squares(x: np.ndarray) -> np.ndarray:
    """x * x without overflow: as int64 where that holds it, else as Python integers."""
    return x * x if np.abs(x).max(initial=0) < 2 ** 31 else x.astype(object) ** 2


def _moments(blocks: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """(rows, exact sums per dimension, exact sum of all squares)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * dim, 0
        for batch in batches:
            for size, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _rows(x, size, dim)
                n += size
                sums = [s + t for s, t in zip(sums, _exact_sum(x), strict=True)]
                y = _squares(x)
                squares += sum(y.ravel().tolist()) if y.dtype == object else sum(_exact_sum(y))
        values = [n, squares, *sums]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["at", "v"])

    parts = blocks.select("size", "x").mapInArrow(partial, "at int, v decimal(38,0)")
    # one row per dimension
    found = {r.at: int(r.v) for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    return found.get(0, 0), [found.get(i + 2, 0) for i in range(dim)], found.get(1, 0)


class _Centre:
    """The mean as a whole part and a rest, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def _summed(blocks: DataFrame, dim: int, shape: tuple[int, int], of) -> np.ndarray:
    """The sum over all blocks of ``of(rows)``, a small matrix: per task first, then one aggregation by matrix row."""
    height, width = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for size, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += of(_rows(x, size, dim))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(height), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]],
            names=["i", *[f"y{j}" for j in range(width)]])

    names = [f"y{j}" for j in range(width)]
    parts = blocks.select("size", "x").mapInArrow(partial, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    # as many rows as a vector has entries
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.i] = [r[c] for c in names]
    return out


class _Probe:
    """Lanczos on one column, fed by the passes of the filter."""

    def __init__(self, dim: int, rng: np.random.Generator):
        v = rng.standard_normal(dim)
        self.basis = [v / np.linalg.norm(v)]
        self.alpha: list[float] = []
        self.beta: list[float] = []

    def column(self) -> np.ndarray:
        return self.basis[-1]

    def feed(self, product: np.ndarray) -> None:
        if len(self.alpha) == len(self.basis):
            return  # the space is exhausted
        self.alpha.append(float(self.basis[-1] @ product))
        known = np.array(self.basis)
        for _ in range(2):
            product = product - known.T @ (known @ product)
        norm = float(np.linalg.norm(product))
        self.beta.append(norm)
        if norm > 1e-10 * max(map(abs, self.alpha)) and len(self.basis) < len(product):
            self.basis.append(product / norm)

    def least(self) -> float:
        """A value that the spectrum is not expected below."""
        k = len(self.alpha)
        if not k:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:k - 1], 1) + np.diag(self.beta[:k - 1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(self.beta[-1] * vectors[-1, 0])))


def leading_pairs(product, dim: int, keep: int, degree: int = DEGREE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric non-negative operator, ``keep`` at most.

    ``product(Y)`` gives V Y for a matrix of columns. A round whose pairs are not
    converged filters the whole block again; if residuals stop falling above
    rounding level, or ``ROUNDS`` are used up, this raises instead of returning
    pairs it cannot vouch for. Directions whose eigenvalue is rounding are left out.
    """
    keep = min(keep, dim)
    width = min(dim, 4 * keep)
    rng = np.random.default_rng(seed)
    probe = _Probe(dim, rng)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]

    def step(y: np.ndarray) -> np.ndarray:
        both = product(np.column_stack([y, probe.column()]))
        probe.feed(both[:, -1])
        return both[:, :-1]

    before = np.inf
    for _ in range(ROUNDS):
        z = step(q)
        h = q.T @ z
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, z = q @ u, z @ u
        top = theta[0]
        if not top > 0:
            return np.empty(0), np.empty((dim, 0))
        residual = np.linalg.norm(z[:, :keep] - q[:, :keep] * theta[:keep], axis=0).max() / top
        if width == dim or residual <= TOLERANCE or (residual <= ROUNDING and residual > before / 2):
            real = theta[:keep] > 1e-13 * dim * top
            return theta[:keep][real], q[:, :keep][:, real]
        before = residual
        # Chebyshev filter: [low, high] is damped, growth is scaled by its value at the top
        low, high = min(probe.least(), 0.999 * theta[-1]), theta[-1]
        half, middle = (high - low) / 2, (high + low) / 2
        sigma = first = half / (top - middle)
        old, y = q, (z - middle * q) * (first / half)
        for _ in range(degree - 1):
            new_sigma = 1 / (2 / first - sigma)
            old, y, sigma = y, 2 * new_sigma / half * (step(y) - middle * y) - sigma * new_sigma * old, new_sigma
        q = np.linalg.qr(y)[0]
    raise RuntimeError(f"subspace iteration did not converge: residual {before:.2g} of the largest eigenvalue")


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row: sum over dimensions of (n * x - S)^2, as Python integers."""
    squares = _squares(x).sum(axis=1) if np.abs(x).max(initial=0) < 2 ** 24 else (x.astype(object) ** 2).sum(axis=1)
    if np.abs(x).max(initial=0) < 2 ** 24:
        # S in pieces of 24 bits: each inner product stays within long for up to 2^14 dimensions
        crossed, rest, shift = [0] * len(x), [abs(s) for s in sums], 0
        sign = np.array([1 if s >= 0 else -1 for s in sums], dtype=np.int64)
        while any(rest):
            piece = np.array([r & 0xFFFFFF for r in rest], dtype=np.int64) * sign
            crossed = [c + (int(p) << shift) for c, p in zip(crossed, x @ piece, strict=True)]
            rest, shift = [r >> 24 for r in rest], shift + 24
    else:
        crossed = (x.astype(object) * np.array(sums, dtype=object)).sum(axis=1).tolist()
    whole = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * c + whole for a, c in zip(squares, crossed, strict=True)]


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", keep: int = KEEP) -> DataFrame:
    """Coordinates of every usable vector on the leading components, each of variance one.

    One row per vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_exact``. ``deviation`` is null where it does
    not fit a long; ``deviation_exact`` is the same as a decimal.

    Dropped: null and empty vectors, vectors with a null or non-finite entry (or
    one beyond 2^51, which has no long), and vectors of another length than the
    most frequent one (the longer one of a tie). Repeated and null ids are rows like
    others. Directions without variance have no component, so a table of equal
    vectors, like an empty one, gives no rows.
    """
    spark = embeddings.sparkSession
    plain = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = stored(_blocks(plain), "vector-blocks")
    lengths = blocks.groupBy("dim").agg(F.sum("size").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    result = PAIRS.replace(", deviation_exact", ", identity_error double, deviation_exact")
    if usual is None:
        return spark.createDataFrame([], result)
    dim = usual.dim
    blocks = blocks.where(F.col("dim") == dim)
    n, sums, squares = _moments(blocks, dim)
    centre = _Centre(n, sums)
    trace = float((n * squares - sum(s * s for s in sums)) / (n * n)) if n else 0.0

    def product(y: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ y)
        return _summed(blocks, dim, y.shape, of) / n

    values, vectors = leading_pairs(product, dim, keep) if trace > 0 else (np.empty(0), np.empty((dim, 0)))
    k = len(values)
    if not k:
        return spark.createDataFrame([], result)
    scaled = vectors / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    seen = _summed(blocks, dim, (k + 1, k), spread) / n
    error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = _rows(x, size, dim)
                w = centre(x) @ scaled
                exact = _exact_deviation(x, n, sums)
                each = pa.array(np.repeat(np.arange(size), k))
                fits = pa.array([d if d < 2 ** 63 else None for d in exact], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, dtype=np.int64)), fits.take(each), pa.array(w.ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array([Decimal(d) if d < 10 ** 38 else None for d in exact], pa.decimal128(38, 0)).take(each),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_exact"])

    rows = blocks.select("size", "ids", "x").mapInArrow(project, PAIRS)
    return rows.withColumn("identity_error", F.lit(error)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")
