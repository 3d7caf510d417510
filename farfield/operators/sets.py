"""Set operations on points: identity by coordinates, lookup, box search, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_points(points: DataFrame) -> DataFrame:
    """One row per coordinate vector: the smallest ``i`` stands for all copies.

    Partial aggregation keeps one row per vector and map task, so any number of copies
    of one point reaches the shuffle as a handful of rows.
    """
    return points.groupBy("x").agg(F.min("i").alias("i")).select("i", "x")


def first_arrivals(points: DataFrame, order: str = "seq") -> DataFrame:
    """One row per coordinate vector: the earliest arrival, with all its columns."""
    rest = [c for c in points.columns if c not in ("x", order)]
    earliest = points.groupBy("x").agg(F.min(F.struct(order, *rest)).alias("first"))
    return earliest.select("first.*", "x").select(*points.columns)


def spread_to_copies(points: DataFrame, scored: DataFrame) -> DataFrame:
    """Give every original row the columns computed for its representative.

    ``points`` has ``i`` and ``x``; ``scored`` has one row per distinct ``x``.
    """
    extra = [c for c in scored.columns if c not in points.columns]
    return points.join(scored.select("x", *extra), "x")


def add_points(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Union in which coordinates already stored, or repeated in the increment, are no-ops."""
    fresh = first_arrivals(arriving).join(stored.select("x"), "x", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def delete_points(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the points whose coordinates appear in ``gone``."""
    return stored.join(gone.select("x"), "x", "left_anti").select(*stored.columns)


def exact_lookup(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored points whose coordinates equal those of a wanted vector (``q``)."""
    return stored.join(wanted.select("q", "x"), "x").select("q", *stored.columns)


def box_search(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Points inside one axis-aligned box, bounds included: a filter on the scan."""
    inside = F.lit(True)
    for j, (least, most) in enumerate(zip(low, high)):
        inside = inside & F.col("x")[j].between(F.lit(float(least)), F.lit(float(most)))
    return points.filter(inside)


def box_join(points: DataFrame, boxes: DataFrame, cells: list[float]) -> DataFrame:
    """All (box, point) pairs with the point inside the box, bounds included.

    Both sides are keyed by a grid over the leading coordinates, ``cells`` wide: a point
    falls in one cell, a box in every cell it covers, so the join is an equi-join.  Cells
    about as wide as a typical box keep both sides small.
    """
    grid = lambda v, width: F.floor(v / F.lit(float(width)))
    keyed, covers, names = points, boxes, [f"cell{j}" for j in range(len(cells))]
    for j, (name, width) in enumerate(zip(names, cells)):
        keyed = keyed.withColumn(name, grid(F.col("x")[j], width))
        span = F.sequence(grid(F.col("lo")[j], width), grid(F.col("hi")[j], width))
        covers = covers.withColumn(name, F.explode(span))
    # the leading coordinates are compared by plain expressions, which are compiled, others in a loop
    inside = F.lit(True)
    for j in range(len(cells)):
        inside &= (F.col("x")[j] >= F.col("lo")[j]) & (F.col("x")[j] <= F.col("hi")[j])
    rest = F.zip_with("x", F.arrays_zip("lo", "hi"), lambda v, b: (v >= b["lo"]) & (v <= b["hi"]))
    inside &= (F.size("x") <= len(cells)) | F.forall(rest, lambda ok: ok)
    return covers.join(keyed, names).filter(inside).select("box", *points.columns)


def union_distinct(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti").select(*left.columns)


def unmatched_within(
    received: DataFrame, expected: DataFrame, on: list[str], value: str, tolerance: float
) -> DataFrame:
    """Symmetric difference of two keyed results; values closer than ``tolerance`` agree."""
    both = received.select(*on, F.col(value).alias("received")).join(
        expected.select(*on, F.col(value).alias("expected")), on, "full_outer"
    )
    agree = F.coalesce(F.abs(F.col("received") - F.col("expected")) <= tolerance, F.lit(False))
    return both.filter(~agree)
