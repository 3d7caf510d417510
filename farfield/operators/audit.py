"""Invariants of scored sets as counted checks: ``check, checked, violations``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.operators.knn import edges


def _count(rows: DataFrame, name: str, violated: Column) -> DataFrame:
    return rows.agg(
        F.count("*").alias("checked"),
        F.coalesce(F.sum(violated.cast("bigint")), F.lit(0)).cast("bigint").alias("violations"),
    ).select(F.lit(name).alias("check"), "checked", "violations")


def _all(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def profile_checks(neighbourhoods: DataFrame, k: int) -> DataFrame:
    """Neighbourhoods of a set with more than ``k`` points, taken without virtual points."""
    closer = F.size(F.filter("nbrs", lambda e: e["dist"] < F.col("kd")))
    within = F.size(F.filter("nbrs", lambda e: e["dist"] <= F.col("kd")))
    dists = F.transform("nbrs", lambda e: e["dist"])
    ids = F.transform("nbrs", lambda e: e["j"])
    kd_of = neighbourhoods.select(F.col("i").alias("j"), F.col("kd").alias("kd_j"))
    edge = edges(neighbourhoods).join(kd_of, "j")
    reach = F.greatest("kd_j", "dist")
    valid = ((reach == F.col("kd_j")) | (reach == F.col("dist"))) & (reach >= 0)
    return _all(
        _count(neighbourhoods, "at least k neighbours", F.size("nbrs") < k),
        _count(neighbourhoods, "fewer than k closer than kd", closer > k - 1),
        _count(neighbourhoods, "all neighbours within kd", within != F.size("nbrs")),
        _count(neighbourhoods, "sorted ascending", dists != F.array_sort(dists)),
        _count(neighbourhoods, "self not a neighbour", F.array_contains(ids, F.col("i"))),
        _count(edge, "valid reach distance", ~valid),
    )


def deletion_checks(left: DataFrame, gone: DataFrame) -> DataFrame:
    """No deleted point remains as a point or as a neighbour."""
    marked = gone.select("i", F.lit(True).alias("hit"))
    as_point = left.select("i").join(marked, "i", "left")
    as_neighbour = edges(left).join(marked.withColumnRenamed("i", "j"), "j", "left")
    trace = F.col("hit").isNotNull()
    return _all(
        _count(as_point, "not a point", trace), _count(as_neighbour, "not a neighbour", trace)
    )


def area_checks(areas: DataFrame, dims: int) -> DataFrame:
    """Centres are unique and real, and every area has two virtual points per axis."""
    from farfield.streaming.areas import virtual_points

    centers = areas.groupBy("center").agg(F.count("*").alias("n"))
    rim = virtual_points(areas, dims).groupBy("center").agg(F.countDistinct("j").alias("n"))
    counted = areas.select("center").join(rim, "center", "left")
    return _all(
        _count(centers, "unique centre", F.col("n") > 1),
        _count(areas, "real centre", F.col("center") < 0),
        _count(counted, "two virtual points per axis", F.coalesce("n", F.lit(0)) != 2 * dims),
    )
