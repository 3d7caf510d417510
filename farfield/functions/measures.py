"""Distances between dense vectors, each as a Column expression and on NumPy arrays.

The Column form serves SQL plans, the array form the kNN join, where one Arrow batch
holds bounded blocks of points.  Both add the terms in coordinate
order, so the two forms agree to the last bit and ties stay ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: p * q))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; NaN when either vector is all zero."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(a, b), scale))


def intersection(a: Column, b: Column) -> Column:
    """One minus shared mass over the larger mass; 1 when that mass is zero."""
    shared = _total(F.zip_with(a, b, lambda p, q: F.least(p, q)))
    area = F.greatest(_total(a), _total(b))
    return F.when(area == 0, F.lit(1.0)).otherwise(1 - F.try_divide(shared, area))


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_text(a: Column, b: Column) -> Column:
    """Positions of two equally long strings that differ."""
    unequal = F.zip_with(
        F.split(a, ""), F.split(b, ""), lambda p, q: F.when(p == q, F.lit(0)).otherwise(F.lit(1))
    )
    return F.aggregate(unequal, F.lit(0), lambda acc, v: acc + v)


def reach_distance(kdist_of_neighbour: Column, dist: Column) -> Column:
    return F.greatest(kdist_of_neighbour, dist)


def virtual_distance(to_center: Column, radius: Column, axis: Column, side: Column, measure: str) -> Column:
    """Distance from a point to a virtual point standing on the rim of a summarized area.

    The first axis is taken to run through the point, so its two virtual points lie
    at ``d - R`` and ``d + R``; the others are off the line by the radius.
    """
    name = resolve(measure).name
    if name == "euclidean":
        off_axis = F.sqrt(to_center * to_center + radius * radius)
    elif name == "manhattan":
        off_axis = to_center + radius
    else:
        raise ValueError(f"virtual points are defined for euclidean and manhattan, not {measure!r}")
    on_axis = F.when(side == 0, to_center - radius).otherwise(to_center + radius)
    return F.when(axis == 0, on_axis).otherwise(off_axis)


def _ordered_sum(a: np.ndarray, b: np.ndarray, term: Callable) -> np.ndarray:
    """Sum over the last axis in coordinate order; ``a`` and ``b`` broadcast.

    ``term(p, q, out)`` writes one coordinate's contribution.
    """
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    total, part = np.zeros(shape), np.empty(shape)
    for j in range(a.shape[-1]):
        term(a[..., j], b[..., j], part)
        total += part
    return total


def _square_gap(p, q, out):
    np.subtract(p, q, out=out)
    np.multiply(out, out, out=out)


def _gap(p, q, out):
    np.subtract(p, q, out=out)
    np.abs(out, out=out)


def _squares(a, b):
    return _ordered_sum(a, b, _square_gap)


def _euclidean_rows(a, b):
    return np.sqrt(_squares(a, b))


def _square_above(distance):
    """No square whose root is within ``distance`` is larger than this."""
    return distance * distance * (1 + 4 * np.finfo(float).eps)


def _same(values):
    return values


def _manhattan_rows(a, b):
    return _ordered_sum(a, b, _gap)


def _cosine_rows(a, b):
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.sqrt(_ordered_sum(a, a, np.multiply) * _ordered_sum(b, b, np.multiply))
        return 1 - _ordered_sum(a, b, np.multiply) / scale


def _intersection_rows(a, b):
    ones = np.ones(a.shape[-1])
    area = np.maximum(_ordered_sum(a, ones, np.multiply), _ordered_sum(b, ones, np.multiply))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(area == 0, 1.0, 1 - _ordered_sum(a, b, np.minimum) / area)


def _euclidean_screen(a, b, limit):
    of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    right = (-2 * b).T

    def about(part):
        squares = a[part] @ right  # without the row's own part
        squares += of_b
        return squares

    off = 8 * a.shape[1] * np.finfo(float).eps * (of_a + np.fmax.reduce(of_b, initial=0.0))
    return about, _square_above(limit) - of_a + off, off


def _manhattan_screen(a, b, limit):
    """Coordinates as small integers: a sum of gaps errs by at most a step for each of them."""
    dims = a.shape[1]
    steps = np.iinfo(np.int16).max // dims
    ends = [f.reduce(x, axis=None, initial=at) for x in (a, b) for f, at in ((np.minimum, np.inf), (np.maximum, -np.inf))]
    low, width = min(ends[0], ends[2]), max(ends[1], ends[3]) - min(ends[0], ends[2])
    if steps < 16 or not 0 < width / max(1, steps) < np.inf:
        return (lambda part: _manhattan_rows(a[part][:, None, :], b[None, :, :])), limit, np.zeros(len(a))
    step = width / steps
    left, right = (np.clip(np.rint((x - low) / step), 0, steps).astype(np.int16, order="C") for x in (a, b.T))

    def about(part):
        rows = left[part]
        total, gap = np.zeros((len(rows), right.shape[1]), np.int16), np.empty((len(rows), right.shape[1]), np.int16)
        for j in range(dims):
            _gap(rows[:, j, None], right[j], gap)
            total += gap
        return total.astype(np.float32)  # whole numbers, in steps

    off = np.full(len(a), dims + 1, np.float32)  # one more for rounding
    return about, np.minimum(limit / step, 1 << 20).astype(np.float32) + off, off


def _cosine_screen(a, b, limit):
    of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        ends = [f.reduce(of_a, initial=1.0) * f.reduce(of_b, initial=1.0) for f in (np.fmin, np.fmax)]
    if np.finfo(float).tiny <= ends[0] and ends[1] < np.inf:
        # unit vectors: single precision errs by as little for all of them
        kind = np.float32
        left = np.divide(a, np.sqrt(of_a)[:, None]).astype(kind)
        right = np.divide(b, -np.sqrt(of_b)[:, None]).astype(kind).T

        def about(part):
            return left[part] @ right  # the distance less 1
    else:  # products of norms that are no numbers, as in the distance itself
        kind = np.float64

        def about(part):
            with np.errstate(invalid="ignore", divide="ignore", over="ignore", under="ignore"):
                scale = np.sqrt(of_a[part, None] * of_b)
                return -np.divide(a[part] @ b.T, scale, out=np.full(scale.shape, -np.inf), where=scale > 0)

    off = np.full(len(a), 16 * (a.shape[1] + 1) * np.finfo(kind).eps, kind)
    return about, (limit - 1).astype(kind) + off, off


@dataclass(frozen=True)
class Measure:
    """A distance: ``column`` for plans, ``rows`` for the kNN join.

    ``rows`` takes arrays whose last axis is the coordinates and broadcasts the others.
    ``box`` names how far two bounding boxes must be apart: ``l2``, ``l1``, ``unit``
    (boxes over unit vectors) or ``None`` when boxes say nothing, in which case the kNN
    join compares every block of points with every other.  ``screen`` is used when there are
    many coordinates: a function that gives, for a slice of the rows, something cheap that orders
    a row's pairs like their distances but for an error; then the level above which a pair is
    beyond its row's limit, and that error, per row.
    """

    name: str
    column: Callable[[Column, Column], Column] | None
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    box: str | None = None
    screen: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[Callable[[slice], np.ndarray], np.ndarray, np.ndarray]] | None = None
    cheap: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    unkey: Callable[[np.ndarray], np.ndarray] = _same
    lift: Callable[[np.ndarray], np.ndarray] = _same

    @property
    def key(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Something cheaper that orders pairs alike: ``unkey`` makes it the distance,
        ``lift`` turns a distance into a key no smaller than any within it."""
        return self.cheap or self.rows

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All distances between two sets of points."""
        return self.rows(a[:, None, :], b[None, :, :])


MEASURES = {
    m.name: m
    for m in (
        Measure(
            "euclidean", euclidean, _euclidean_rows, "l2", _euclidean_screen,
            cheap=_squares, unkey=np.sqrt, lift=_square_above,
        ),
        Measure("manhattan", manhattan, _manhattan_rows, "l1", _manhattan_screen),
        Measure("cosine", cosine, _cosine_rows, "unit", _cosine_screen),
        Measure("intersection", intersection, _intersection_rows),
    )
}


def resolve(measure: str | Measure) -> Measure:
    """Look a measure up by name (any case), or pass a user's own through."""
    if isinstance(measure, Measure):
        return measure
    found = MEASURES.get(str(measure).lower())
    if found is None:
        raise ValueError(f"unknown distance {measure!r}; known: {', '.join(sorted(MEASURES))}")
    return found
