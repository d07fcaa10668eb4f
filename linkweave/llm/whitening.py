"""Whitening of embeddings by LOBPCG over the distributed covariance.

Entries become whole numbers x = floor(64 c) + 1000000. Each different x-vector is fitted once; sums are exact, and rows are
centred as (n x - S) / n from whole numbers before anything is multiplied. The covariance is never formed: each round needs only
its product with a block of directions, which every task sums over its rows (centred rows times block, transposed rows times
that) and Spark adds up. Rayleigh-Ritz then takes place over the orthonormal basis of the block, its residuals and the previous
directions. The block holds as many guard directions as wanted ones. Rounds end once every wanted residual, from a fresh product,
is under TOLERANCE of the greatest eigenvalue, and whitening starts only with that certificate.

The driver holds matrices of the vectors' length by three blocks, however many rows there are; rows never leave their tasks.

Edge cases: vectors that are null, empty, of another length than most, or that hold null or non-finite entries are left out; a
null vec_id and repeated rows give rows like others; components whose eigenvalue is 0 (to rounding) can't be whitened and are
left out, so one different vector alone gives an empty result, as does an empty table; a deviation beyond a long is null; other
columns are ignored; ties of eigenvalues give any orthonormal vectors of their space.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidied

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
TOLERANCE, ROUNDS = 1e-13, 500
KINDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.size(v) > 0)
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    rows = materialise(rows.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")), "whole")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("x") == (usual[0].d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once: x less the whole part of the mean is exact."""
    return (x - np.array([s // n for s in sums])).astype(np.float64) - np.array([s % n / n for s in sums])


class Fit:
    """The different x-vectors: their number n and sums S, exact, and products with their covariance."""

    def __init__(self, rows: DataFrame):
        self.points = materialise(rows.select("x").distinct(), "points")
        sums = self.points.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("j").collect()
        self.n = sums[0].n if sums else 0
        self.sums = [int(r.s) for r in sums]

    def added(self, block) -> np.ndarray:
        """The sum over tasks of block(centred rows), a matrix, divided by n."""
        n, sums = self.n, self.sums

        def partial_sums(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = block(centred(_matrix(batch.column(0)), n, sums))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["j", "y"])

        each = self.points.mapInArrow(lambda b: tidied(partial_sums(b)), "j long, y array<double>")
        rows = each.select("j", F.posexplode("y").alias("k", "c")).groupBy("j", "k").agg(F.sum("c").alias("c")).collect()
        out = np.zeros((1 + max(r.j for r in rows), 1 + max(r.k for r in rows)))
        for r in rows:
            out[r.j, r.k] = r.c
        return out / self.n

    def product(self, directions: np.ndarray) -> np.ndarray:
        """Covariance times directions."""
        return self.added(lambda x: x.T @ (x @ directions))

    def trace(self) -> float:
        return float(self.added(lambda x: (x * x).sum(axis=0, keepdims=True)).sum())


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to against, twice cleaned; directions that add nothing drop out."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s.max(initial=0))]
    return block


def eigenpairs(product, d: int, wanted: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the wanted greatest eigenvalues of a symmetric operator, by LOBPCG."""
    wanted = min(wanted, d)
    size = min(d, 2 * wanted)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((d, size)))[0]
    vx = product(x)
    p = vp = np.zeros((d, 0))
    fresh = True
    for _ in range(rounds):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        residual = vx - x * values
        worst = np.linalg.norm(residual, axis=0)
        w = orthonormal(residual, np.hstack([x, p]))
        done = worst[:wanted].max() <= tolerance * max(values[0], np.finfo(float).tiny)
        if (done or not w.shape[1]) and fresh:
            return values[:wanted], x[:, :wanted], worst[:wanted]
        if done or not w.shape[1]:  # certify by a fresh product, free of what rounds have added up
            x = np.linalg.qr(x)[0]
            vx, fresh, p, vp = product(x), True, np.zeros((d, 0)), np.zeros((d, 0))
            continue
        basis, image = np.hstack([x, w, p]), np.hstack([vx, product(w), vp])
        small = basis.T @ image
        turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :size]
        step = turn.copy()
        step[:size] = 0  # the part of the new block outside the old one
        step = orthonormal(step, turn)[:, :size]
        x, vx, p, vp = basis @ turn, image @ turn, basis @ step, image @ step
        fresh = False
    raise RuntimeError(f"no certificate after {rounds} rounds: residuals {worst[:wanted].max():.3g} of {values[0]:.3g}")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exact; None beyond a long."""
    about = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(axis=1)
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 and about.max(initial=0) < 4e18:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _whiten_batches(batches, n, sums, turn, explained, error):
    return tidied(_whitened(batches, n, sums, turn, explained, error))


def _whitened(batches, n, sums, turn, explained, error):
    k = len(explained)
    for batch in batches:
        x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, rows).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array([e for e in deviations(part, n, sums) for _ in range(k)], pa.int64()),
                    pa.array((centred(part, n, sums) @ turn).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    rows = whole(rows)
    fit = Fit(rows)
    empty = rows.sparkSession.createDataFrame([], KINDS)
    if fit.n < 2:
        return empty
    values, vectors, _ = eigenpairs(fit.product, len(fit.sums), components)
    held = values > 1e-12 * max(values[0], 0)
    if not held.any():
        return empty
    values, vectors = values[held], vectors[:, held]
    turn = vectors / np.sqrt(values)
    error = float(np.abs(fit.added(lambda x: (x @ turn).T @ (x @ turn)) - np.eye(len(values))).max())
    explained = values / fit.trace()
    discard(fit.points)
    return rows.select("vec_id", "x").mapInArrow(partial(_whiten_batches, n=fit.n, sums=fit.sums, turn=turn, explained=explained, error=error), KINDS)
