"""Whitened embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows are scaled to integers, so that equality, sums and deviations are exact. Every step is one
pass of Spark over blocks of distinct rows X, centred: it multiplies Xv, takes the earlier left
vectors out of it, and sums what Xᵀu needs. Left vectors are as long as the table and are never
kept: each row finds its own entries of them again from its products with the right vectors and the
small triangular factor R of XV = UR. Both sides are made orthogonal in full. The driver holds V
(dimensions x steps) and R alone, and the singular values of R give deviations and components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import written

SCALE, COMPONENTS = 256, 4
#: Up to so many dimensions take all steps, so that equal deviations are all found; more end where COMPONENTS have converged.
ALL_STEPS, TOLERANCE = 256, 1e-14
BLOCK_ROWS = 4096
#: Variance below this share of the whole is rounding.
LEAST_SHARE = 1e-14


def whole_numbers(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` with x, the vector's entries times ``scale`` rounded down (array<long>); rows whose vector is null or has null or non-finite entries go. An entry beyond 2**62 in size becomes that; vectors shorter than the longest get zeros behind."""
    entries = F.col(vector_col).cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    low, high = F.lit(-float(1 << 62)), F.lit(float(1 << 62))
    x = F.transform(entries, lambda c: F.floor(F.least(F.greatest(c * scale, low), high)).cast("long"))
    return rows.filter(F.col(vector_col).isNotNull() & good).withColumn("x", x)


def _padded(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("x", F.when(F.size("x") < size, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))).otherwise(F.col("x")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column, all of ``size`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _sums(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), size)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size), pa.int64()), pa.array(np.r_[0, high]), pa.array(np.r_[len(x), low])], names=["k", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r.k: (int(r.high) << 32) + int(r.low) for r in blocks.mapInArrow(parts, "k long, high long, low long").groupBy("k").agg(exact("high"), exact("low")).collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


class Centre:
    """x - S/n without cancellation: whole parts of the means are subtracted as integers."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest


def _totals(blocks: DataFrame, size: int, centre: Centre, of) -> np.ndarray:
    """The sum over all rows of the vector that ``of`` makes of a block of centred rows: summed in every task, then by Spark."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = of(centre(_matrix(b.column("x").slice(at, BLOCK_ROWS), size)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["k", "v"])

    rows = blocks.mapInArrow(parts, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.k] = r.v
    return out


def _fresh(rng: np.random.Generator, v: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``v``."""
    x = rng.standard_normal(len(v))
    for _ in range(3):
        x -= v @ (v.T @ x)
        x /= np.linalg.norm(x)
    return x


class Bidiagonal:
    """The growing factorisation XV = UR with orthonormal U and V; R is upper bidiagonal but for what reorthogonalisation takes out."""

    def __init__(self, size: int, trace: float):
        self.rng = np.random.default_rng(20240607)
        self.v = np.zeros((size, 0))
        self.r = np.zeros((0, 0))
        self.xtu = np.zeros((size, 0))  # Xᵀu of every left vector
        self.trace, self.next, self.beta = trace, _fresh(self.rng, self.v), 0.0

    def work(self):
        """What a block of centred rows adds in this step: Xᵀp, Uᵀp and p·p for p = Xv without what it is known to share with earlier left vectors, by the rows' own entries of these."""
        v, r, new, known = self.v, self.r, self.next, self.xtu.T @ self.next
        live = np.diag(r) > 0
        solve = np.zeros_like(r)  # U = XV times this; left vectors of no length stay out
        if live.any():
            solve[np.ix_(live, live)] = np.linalg.inv(r[np.ix_(live, live)])

        def of(x: np.ndarray) -> np.ndarray:
            u = (x @ v) @ solve
            p = x @ new - u @ known
            return np.concatenate([x.T @ p, u.T @ p, [p @ p]])

        return of

    def step(self, totals: np.ndarray) -> None:
        size, k = len(self.v), self.v.shape[1]
        xtp, c, square = totals[:size], totals[size : size + k], totals[-1]
        xtp = xtp - self.xtu @ c
        left = square - c @ c
        alpha = float(np.sqrt(left)) if left > LEAST_SHARE / 10 * self.trace else 0.0
        r = np.zeros((k + 1, k + 1))
        r[:k, :k], r[:k, k], r[k, k] = self.r, self.xtu.T @ self.next + c, alpha
        self.v, self.r = np.c_[self.v, self.next], r
        xtu = xtp / alpha if alpha else np.zeros(size)
        self.xtu = np.c_[self.xtu, xtu]
        w = xtu.copy()
        for _ in range(2):
            w -= self.v @ (self.v.T @ w)
        self.beta = float(np.linalg.norm(w))
        if k + 1 < size:
            if self.beta > 1e-11 * np.sqrt(self.trace):
                w /= self.beta
                w -= self.v @ (self.v.T @ w)
                self.next = w / np.linalg.norm(w)
            else:  # an invariant subspace: go on outside it
                self.beta, self.next = 0.0, _fresh(self.rng, self.v)

    def converged(self, wanted: int) -> bool:
        """Whether the largest singular values leave residuals of no size."""
        left, sigma, _ = np.linalg.svd(self.r)
        return bool(len(sigma) >= wanted and (self.beta * np.abs(left[-1, :wanted]) <= TOLERANCE * sigma[0]).all())


def refined(state: Bidiagonal, wanted: int, product) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the largest singular values and their vectors, corrected to first order by one more ``product`` XᵀXw of each: left vectors found again by a small R are not quite orthogonal."""
    _, sigma, right = np.linalg.svd(state.r)
    basis, theta, k = state.v @ right.T, sigma**2, min(wanted, len(sigma))
    seen = basis.T @ product(basis[:, :k])
    gap = theta[:k] - theta[:, None]
    apart = np.abs(gap) > 1e-6 * theta[0]
    vectors, _ = np.linalg.qr(basis[:, :k] + basis @ np.where(apart, seen / np.where(apart, gap, 1), 0))
    return np.diag(seen[:k]).copy(), vectors


def bidiagonalise(blocks: DataFrame, size: int, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns) of the covariance, largest first, without those of no variance; and its trace."""
    centre = Centre(n, sums)
    trace = float(_totals(blocks, size, centre, lambda x: np.array([(x * x).sum()]))[0]) if n > 1 else 0.0
    if trace == 0:
        return np.zeros(0), np.zeros((size, 0)), 0.0
    state = Bidiagonal(size, trace)
    for _ in range(size):
        state.step(_totals(blocks, size, centre, state.work()))
        if size > ALL_STEPS and state.converged(components):
            break
    values, vectors = refined(state, components, lambda w: _totals(blocks, size, centre, lambda x: (x.T @ (x @ w)).ravel()).reshape(w.shape))
    real = values > LEAST_SHARE * trace
    return values[real] / n, vectors[:, real], trace / n


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``rows`` whose vectors are sound, with n, deviation, components: array of (component, whitened, explained) from the largest variance down, and identity_error.

    The covariance is that of the distinct integer vectors, each counted once, n of them. A
    component without variance (a share of LEAST_SHARE or less) is left out, so fewer distinct
    vectors or dimensions give fewer
    components, one vector none. deviation is null where it exceeds a long. Repeated rows and null
    ids stay; other columns are kept, those of the added names replaced; an empty table gives none.
    """
    added = ("x", "n", "deviation", "components", "identity_error")
    read = whole_numbers(rows.drop(*added), vector_col, scale)
    size = read.agg(F.max(F.size("x"))).first()[0] or 0
    read = _padded(read, size)
    blocks = written(read.select("x").dropDuplicates(["x"]), "distinct-vectors", compression="zstd")
    n, sums = _sums(blocks, size) if size else (0, [])
    values, vectors, trace = bidiagonalise(blocks, size, n, sums, components) if n else (np.zeros(0), np.zeros((size, 0)), 0.0)
    k = len(values)
    error = 0.0
    if k:
        project = Centre(n, sums)
        pairs = vectors / np.sqrt(values)
        of = lambda x: (lambda y: np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)]))(x @ pairs)
        got = _totals(blocks, size, project, of) / n
        mean = got[k * k :]
        error = float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    columns = [c for c in rows.columns if c not in added]
    added_fields = StructType.fromDDL("n long, deviation long, components array<struct<component: int, whitened: double, explained: double>>, identity_error double")
    schema = StructType([*read.select(*columns).schema, *added_fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = Centre(n, sums)
        pairs = vectors / np.sqrt(values)
        for b in batches:
            x = _matrix(b.column("x"), size)
            y = centre(x) @ pairs
            m = len(x)
            each = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(y.ravel()), pa.array(np.tile(values / trace if k else values, m))], names=["component", "whitened", "explained"])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), each)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.full(m, n)), pa.array(_deviations(x, n, sums), pa.int64()), listed, pa.array(np.full(m, error))], names=[*columns, "n", "deviation", "components", "identity_error"])

    return read.select(*columns, "x").mapInArrow(apply, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n*x - S)**2 of every row, null beyond the longs."""
    small = max([*map(abs, sums), int(np.abs(x).max(initial=0)) * n, 1])
    if len(sums) * (2 * small) ** 2 < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)
    return [d if d < 1 << 63 else None for d in exact]


def op12(embeddings: DataFrame) -> DataFrame:
    """A row for each sound vector and each of its components, as ``whiten`` gives them."""
    rows = whiten(embeddings.select("vec_id", "embedding")).select("vec_id", "n", "deviation", "identity_error", F.explode("components").alias("c"))
    return rows.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")
