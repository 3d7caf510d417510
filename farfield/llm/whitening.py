"""Whitening by the leading eigenvectors of a covariance that is never formed.

Subspace iteration with a Chebyshev filter: a block of vectors is multiplied by a polynomial of
the covariance that is small from 0 to the block's lowest Ritz value and grows fast above, so
that the unwanted part of the spectrum dies out.  A step of the polynomial's recurrence is one
pass over the points, each centred before it is multiplied: tasks add up ``X'(XQ)`` of their
points, and only such sums, dimensions by block, are brought together.  Then QR and
Rayleigh-Ritz, until the residuals certify every wanted pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 8
WIDTH = 4  # vectors in the block, by component wanted
CERTIFIED = 1e-13  # residual, by the largest eigenvalue
NOTHING = 1e-12  # an eigenvalue this small beside the largest is no component
SEED = 3
STEPS, ROUNDS = 24, 60  # passes of one filter, filters at most
GROWTH = 1e10  # how far one filter may stretch the block


@dataclass(frozen=True)
class Whitening:
    """``n`` points with sums ``sums`` by dimension; unit ``vectors`` (rows) of ``values``, falling."""

    n: int
    sums: list
    vectors: object
    values: object
    trace: float
    residual: float  # largest of the wanted pairs, by the largest eigenvalue
    passes: int

    @property
    def mean(self):
        import numpy as np

        return np.array(self.sums, dtype=np.float64) / max(1, self.n)


def finite(column: str) -> Column:
    """Whether a vector has entries, and none of them null, NaN or infinite."""
    whole = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce((F.size(column) > 0) & whole, F.lit(False))


def _matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(points: DataFrame, task, rows: int, width: int):
    """The sum over tasks of the matrix, ``rows`` by ``width``, that ``task`` makes of its points."""
    import numpy as np

    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = task(_matrix(batch["x"]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(c) for c in total.T)],
                names=["at", *(f"c{k}" for k in range(width))],
            )

    schema = ", ".join(["at int", *(f"c{k} double" for k in range(width))])
    parts = points.select("x").mapInArrow(made, schema)
    out = np.zeros((rows, width))
    for r in parts.groupBy("at").agg(*(F.sum(f"c{k}") for k in range(width))).collect():
        out[r[0]] = r[1:]
    return out


def fit(points: DataFrame, components: int = COMPONENTS, seed: int = SEED, certified: float = CERTIFIED) -> Whitening:
    """The leading ``components`` of *staged* points ``x array<double>``; those not ``finite`` do not count.

    Divisor of the covariance is the number of points.  There are fewer components where the
    points span fewer dimensions; no points, or equal ones, have none.  Vectors of different
    lengths are an error.  Rows that occur several times count as often.
    """
    import numpy as np

    points = points.filter(finite("x"))
    about = points.agg(
        F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("dims")
    ).first()
    n, dims = about["n"], about["dims"] or 0
    if n and about["least"] != dims:
        raise ValueError(f"vectors of {about['least']} and of {dims} dimensions cannot be whitened together")
    if not n or not dims:
        return Whitening(0, [], np.zeros((0, dims)), np.zeros(0), 0.0, 0.0, 0)
    sums = _summed(points, lambda x: x.sum(axis=0)[:, None], dims, 1)[:, 0]
    mean = sums / n
    trace = float(_summed(points, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], dims, 1).sum()) / n
    passes = 0

    def times(q):
        """The covariance times ``q``: one pass."""
        nonlocal passes
        passes += 1

        def task(x):
            x = x - mean
            return x.T @ (x @ q)

        return _summed(points, task, dims, q.shape[1]) / n

    block = min(dims, WIDTH * components)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, block)))[0]
    best = math.inf
    for _ in range(ROUNDS):
        # Rayleigh-Ritz: the best pairs that the block spans
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        wanted = int((values[:components] > NOTHING * max(values[0], 0.0)).sum())
        if not trace or not wanted:
            return Whitening(n, sums.tolist(), np.zeros((0, dims)), np.zeros(0), trace, 0.0, passes)
        off = np.linalg.norm(image - q * values, axis=0)[:wanted].max() / values[0]
        # rounding alone may stop a residual short of the aim, but never far from it
        if off <= certified or (off <= 100 * certified and off > best / 2):
            return Whitening(n, sums.tolist(), q[:, :wanted].T.copy(), values[:wanted].copy(), trace, float(off), passes)
        best = min(best, off)
        q = _filtered(times, q, image, values, wanted)
    raise ArithmeticError(f"residual {best:.1e} after {passes} passes")


def _filtered(times, q, image, values, wanted: int):
    """The block after a filter that damps 0 to its lowest Ritz value; orthonormal again."""
    import numpy as np

    low = max(values[-1], 0.0)
    if low <= NOTHING * values[0]:  # the block spans all there is: one product drops the rest
        return np.linalg.qr(image)[0]
    place = lambda e: max(2 * e / low - 1, 1 + 1e-12)
    gain = math.acosh(place(values[wanted - 1]))  # what each step adds, as a power of e
    steps = min(STEPS, math.log(GROWTH) / math.acosh(place(values[0])), 1 + math.log(GROWTH) / gain)
    half, scale = low / 2, 1 / place(values[0])
    last, now = q, (image - half * q) * (scale / half)
    for _ in range(max(0, int(steps) - 1)):
        # the scaled recurrence keeps the fastest-growing direction at length one
        following = 1 / (2 * place(values[0]) - scale)
        last, now = now, (times(now) - half * now) * (2 * following / half) - (scale * following) * last
        scale = following
    return np.linalg.qr(now)[0]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` whose ``x array<double>`` is ``finite``, with ``w array<double>``: an entry per component,
    the projection of the centred point over the root of the eigenvalue.  A ``w`` of their own is replaced."""
    import numpy as np

    rows = rows.drop("w").filter(finite("x"))

    mean = model.mean
    scaled = (model.vectors / np.sqrt(model.values)[:, None]).T if len(model.values) else np.zeros((len(model.sums), 0))

    def project(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch["x"])
            w = (x - mean) @ scaled if len(x) else np.zeros((0, scaled.shape[1]))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=[*batch.schema.names, "w"]
            )

    return rows.mapInArrow(project, T.StructType([*rows.schema, T.StructField("w", T.ArrayType(T.DoubleType()))]))


def identity_error(whole: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of *staged* ``w`` minus the identity."""
    import numpy as np

    points = whole.select(F.col("w").alias("x"))
    n = points.count()
    if not n or not components:
        return 0.0
    mean = _summed(points, lambda w: w.sum(axis=0)[:, None], components, 1)[:, 0] / n

    def task(w):
        w = w - mean
        return w.T @ w

    return float(np.abs(_summed(points, task, components, components) / n - np.eye(components)).max())
