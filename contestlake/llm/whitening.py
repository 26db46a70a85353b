"""Whitening by Chebyshev-filtered subspace iteration.

A block of vectors is sent through the covariance again and again: every pass
multiplies it by the centred rows and their transpose, inside the tasks, and
adds the partial products up by dimension.  A Chebyshev polynomial of those
passes damps the part of the spectrum below the block; QR and Rayleigh-Ritz
then give eigenpairs, until their residuals certify them.  What reaches the
driver is a block, dimensions by vectors, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.session import cut_lineage

COMPONENTS = 8
#: Vectors in the block beyond the wanted ones.
EXTRA = 24
#: Residual, as a share of the largest eigenvalue, that certifies a pair.
CERTIFIED = 2e-14
#: A stalled residual below this is the floor of the arithmetic.
FLOOR = 1e-11
#: The strongest direction may grow this much more than the weakest within one filter.
SPREAD = 1e6
MAX_DEGREE = 12
#: Passes that convergence may still need before the block is widened instead.
PATIENCE = 60
#: Bytes of a partition of the prepared rows.
PART_BYTES = 16 << 20
#: Entries whose scaled value is larger do not fit in exact integers.
LARGEST = float(1 << 52)
SHIFT, SCALE = 100_000, 1024

Arrow = Iterator[pa.RecordBatch]


def prepared(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and x = floor(1024 c) + 100000 of the rows that count.

    Rows go whose vector is null, empty, holds a null, a non-finite entry or
    one beyond 2**52 / 1024, or is not as long as the vectors of the most
    frequent length (the greatest on a tie).
    """
    c = F.transform(F.col(column), lambda v: v.cast("double") * SCALE)
    rows = vectors.select("vec_id", c.alias("c")).where("size(c) > 0")
    rows = rows.where(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST)))
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max(F.struct("n", "d")).alias("m")).select("m.*").first()
    n, d = (top["n"], top["d"]) if top["d"] is not None else (0, 0)
    x = F.transform("c", lambda v: F.floor(v).cast("long") + SHIFT)
    parts = max(1, -(-n * d * 8 // PART_BYTES))
    return cut_lineage(rows.where(F.size("c") == d).select("vec_id", x.alias("x")).coalesce(int(parts)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _by_dimension(rows: DataFrame, work, width: int) -> np.ndarray:
    """Sum over all tasks of a (dimensions, width) matrix that ``work`` makes of each batch."""
    names = [f"s{j}" for j in range(width)]

    def run(arrow: Arrow) -> Arrow:
        total = None
        for b in arrow:
            if b.num_rows:
                part = work(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(np.arange(len(total), dtype=np.int32))]
            yield pa.record_batch(columns + [pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)], names=["i", *names])

    kind = "long" if work is _sums else "double"
    parts = rows.select(rows.columns[-1]).mapInArrow(run, "i int, " + ", ".join(f"{s} {kind}" for s in names))
    found = parts.groupBy("i").agg(*[F.sum(s).alias(s) for s in names]).toArrow().sort_by("i")
    return np.stack([found[s].to_numpy() for s in names], axis=1) if found.num_rows else np.zeros((0, width))


def _sums(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0)[:, None]


class Moments:
    """Number of rows, exact sums per dimension, and passes of the centred covariance."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n = rows.count()
        self.sums = _by_dimension(rows, _sums, 1)[:, 0].astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.d = len(self.sums)

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times block, by one pass over the rows."""
        n, sums = self.n, self.sums

        def work(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums)
            return z.T @ (z @ block)

        return _by_dimension(self.rows, work, block.shape[1]) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(_by_dimension(self.rows, lambda x: (centred(x, n, sums) ** 2).sum(axis=0)[:, None], 1).sum()) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: whole numbers first where they fit in 64 bits, else around the whole part of the mean."""
    if len(x) == 0 or max(float(np.abs(x).max()) * n, float(np.abs(sums).max())) < 2**62:
        return (x * n - sums) / n
    whole, rest = np.divmod(sums, n)
    return (x - whole) - rest / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of (n x - sums)**2 per row; null where it does not fit in 64 bits."""
    reach = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
    if reach < 2**62:
        gap = x * n - sums
        if float(np.abs(gap).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**62:
            return (gap * gap).sum(axis=1).tolist()
    large = int(n)
    totals = [sum((large * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [t if t < 2**63 else None for t in totals]


def _filtered(m: Moments, block: np.ndarray, product: np.ndarray, theta: np.ndarray, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance times the block, which has Ritz values ``theta`` and this product.

    The interval from zero to the smallest Ritz value is damped; the usual
    scaling by the value at the largest keeps the numbers in range.
    """
    half = theta[-1] / 2
    sigma = half / (half - theta[0])
    tau = 2 / sigma
    before, now = block, (product - half * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        before, now = now, (m.times(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def _growth(theta: float, edge: float) -> float:
    """Factor by which one more degree lifts an eigenvalue above the damped interval."""
    t = max(2 * theta / edge - 1, 1.0)
    return t + float(np.sqrt(t * t - 1))


def eigenpairs(m: Moments, wanted: int = COMPONENTS, extra: int = EXTRA, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors as columns, residual) of the largest ``wanted`` eigenvalues above zero.

    Slow convergence widens the block; a block as wide as the space is exact
    after one pass, so the loop ends on any spectrum.
    """
    wanted = min(wanted, m.d)
    if not wanted or not m.n:
        return np.zeros(0), np.zeros((m.d, 0)), 0.0
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((m.d, min(m.d, wanted + extra))))[0]
    before, stalled = np.inf, 0
    while True:
        product = m.times(block)
        small = block.T @ product
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        if theta[0] <= 0:
            return np.zeros(0), np.zeros((m.d, 0)), 0.0
        rest = np.linalg.norm(product - block * theta, axis=0)[:wanted]
        residual = float(rest.max()) / float(theta[0])
        stalled = stalled + 1 if residual > before / 2 else 0
        whole = block.shape[1] == m.d
        if residual <= CERTIFIED or (residual <= FLOOR and stalled >= 2) or (whole and stalled >= 3):
            break
        edge = max(float(theta[-1]), float(theta[0]) * 1e-12)
        gain = _growth(float(theta[wanted - 1]), edge)
        passes = np.log(max(residual / CERTIFIED, 2.0)) / max(np.log(gain), 1e-9)
        if not whole and np.isfinite(before) and passes > PATIENCE:
            more = rng.standard_normal((m.d, min(block.shape[1], m.d - block.shape[1])))
            block = np.linalg.qr(np.hstack([block, more]))[0]
        elif whole:
            block = np.linalg.qr(block)[0]
        else:
            lead = _growth(float(theta[0]), edge)
            degree = int(np.clip(np.log(SPREAD) / max(np.log(lead), 1e-9), 2, MAX_DEGREE))
            degree = int(min(degree, max(2, np.ceil(passes))))
            ritz = np.append(theta[:-1], edge)
            block = np.linalg.qr(_filtered(m, block, product, ritz, degree))[0]
        before = residual
    real = int(np.sum(theta[:wanted] > theta[0] * 1e-13))
    return theta[:real].copy(), block[:, :real].copy(), residual


def _whitener(n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray):
    turn = vectors / np.sqrt(values)
    return lambda x: centred(x, n, sums) @ turn


def _error(m: Moments, whiten, k: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; their mean is taken off first."""
    mean = _by_dimension(m.rows, lambda x: whiten(x).sum(axis=0)[:, None], 1)[:, 0] / m.n

    def work(x: np.ndarray) -> np.ndarray:
        w = whiten(x) - mean
        return w.T @ w

    return float(np.abs(_by_dimension(m.rows, work, k) / m.n - np.eye(k)).max())


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component.

    Components whose eigenvalue is zero (fewer dimensions or distinct vectors
    than components, or all vectors alike) cannot be whitened and have no
    rows; an empty table gives none.  Repeated rows are rows of their own, and
    a null vec_id stays null.  ``deviation`` is null where the exact sum does
    not fit in 64 bits.  Other columns are not read.
    """
    rows = prepared(vectors, column)
    m = Moments(rows)
    values, basis, _ = eigenpairs(m, wanted)
    k = len(values)
    n, sums = m.n, m.sums
    project = _whitener(n, sums, values, basis)
    explained = values / m.trace() if k else values
    error = _error(m, project, k) if k else 0.0

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            size = b.num_rows
            if not size or not k:
                continue
            x = _matrix(b.column(1))
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n, dtype=np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(project(x).reshape(-1)),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, error)),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, ROWS)
