"""Locality-sensitive hash families as Column expressions.

A family turns a vector into one signature per hash table; points share a bucket of a
table when their signatures are equal.  Random parameters come from a seed, so every
executor and every re-run sees the same family.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from farfield.functions.measures import Measure, dot, resolve


@dataclass(frozen=True)
class Family:
    """``signature(x, table)`` is any groupable Column; ``measure`` ranks candidates."""

    name: str
    measure: Measure
    tables: int
    signature: Callable[[Column, int], Column]
    bits: int | None = None  # signatures are this many bits in a bigint, if set
    sides: int | None = None  # bits of a signature that tells sides of hyperplanes
    sides_of: Callable[[np.ndarray], np.ndarray] | None = None  # these bits, (points, tables, bits), of rows of points

    def bucket(self, x: Column, table: int) -> Column:
        return F.xxhash64(F.lit(table), self.signature(x, table))

    def buckets(self, x: Column) -> Column:
        return F.array(*(self.bucket(x, t) for t in range(self.tables)))

    def signatures(self, x: Column) -> Column:
        return F.array(*(self.signature(x, t) for t in range(self.tables)))

    def shorter(self, signature: Column, hashes: int) -> Column:
        """What the first ``hashes`` of a signature's hashes give."""
        return F.slice(signature, 1, hashes) if self.bits is None else F.shiftright(signature, self.bits - hashes)


def _literal(values, kind: str = "array<double>") -> Column:
    """Numbers as one constant: thousands of them as expressions of their own would slow every plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def uniform_planes(dims: int, hashes: int, tables: int, seed: int) -> np.ndarray:
    """Normals with coordinates uniform around zero, (tables, hashes, dims)."""
    return np.random.default_rng(seed).random((tables, hashes, dims)) - 0.5


def gaussian_planes(dims: int, hashes: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, hashes, dims))


def sign_family(planes, measure: str | Measure = "euclidean", name: str = "planes") -> Family:
    """One bit per hyperplane: 1 on its positive side.  The first plane is the top bit."""
    planes = np.asarray(planes, dtype=float)
    tables, hashes, _ = planes.shape

    def signature(x: Column, table: int) -> Column:
        normals = _literal(planes[table].tolist(), "array<array<double>>")
        sides = F.transform(normals, lambda normal: (dot(x, normal) > 0).cast("bigint"))
        if hashes > 62:
            return sides
        return F.aggregate(sides, F.lit(0).cast("bigint"), lambda word, side: F.shiftleft(word, 1).bitwiseOR(side))

    flat = planes.reshape(tables * hashes, -1)

    def sides_of(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(flat)))
        for j in range(x.shape[1]):  # in coordinate order, as the column adds
            total += x[:, j, None] * flat[:, j]
        return ((total > 0) | np.isnan(total)).reshape(len(x), tables, hashes)  # Spark takes NaN for the largest

    return Family(name, resolve(measure), tables, signature, hashes if hashes <= 62 else None, hashes, sides_of)


def projection_family(projections, offsets, width: float) -> Family:
    """Place along random directions, in steps of ``width``, rounded half up."""
    if width <= 0:
        raise ValueError("bucket width must be positive")
    projections, offsets = np.asarray(projections, dtype=float), np.asarray(offsets)

    def signature(x: Column, table: int) -> Column:
        made = [{"g": g, "o": float(o)} for g, o in zip(projections[table].tolist(), offsets[table])]
        lines = _literal(made, "array<struct<g: array<double>, o: double>>")
        return F.transform(lines, lambda l: F.floor((dot(x, l["g"]) + l["o"]) / F.lit(float(width)) + 0.5))

    return Family("l2", resolve("euclidean"), len(projections), signature)


def grid_family(shifts, width: float) -> Family:
    """Cell of a randomly shifted grid, all coordinates together, for each hash."""
    if width <= 0:
        raise ValueError("bucket width must be positive")
    shifts = np.asarray(shifts, dtype=float)

    def signature(x: Column, table: int) -> Column:
        origins = _literal(shifts[table].tolist(), "array<array<double>>")
        return F.transform(origins, lambda u: F.zip_with(x, u, lambda v, s: F.floor((v - s) / F.lit(float(width)))))

    return Family("l1", resolve("manhattan"), len(shifts), signature)


def l2_family(dims: int, hashes: int, tables: int, width: float, seed: int) -> Family:
    rng = np.random.default_rng(seed)
    return projection_family(
        rng.normal(size=(tables, hashes, dims)), rng.integers(0, 100, size=(tables, hashes)), width
    )


def l1_family(dims: int, hashes: int, tables: int, width: float, seed: int) -> Family:
    shifts = np.random.default_rng(seed).random((tables, hashes, dims)) * width
    return grid_family(shifts, width)


def cosine_family(dims: int, hashes: int, tables: int, seed: int) -> Family:
    return sign_family(gaussian_planes(dims, hashes, tables, seed), "cosine", "cos")


def family(name: str, dims: int, hashes: int = 4, tables: int = 4, radius: float = 0.0, seed: int = 0) -> Family:
    """A family by name: ``cos``, ``l1`` or ``l2``; buckets are ten radii wide, at least 1."""
    width = max(1, int(10 * radius))
    kind = name.lower()
    if kind == "cos":
        return cosine_family(dims, hashes, tables, seed)
    if kind == "l1":
        return l1_family(dims, hashes, tables, width, seed)
    if kind == "l2":
        return l2_family(dims, hashes, tables, width, seed)
    raise ValueError(f"unknown hash family {name!r}; known: cos, l1, l2")
