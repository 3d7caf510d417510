"""Local outlier factor: from neighbourhoods to densities, scores and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.hashing import Family
from farfield.functions.measures import Measure, reach_distance
from farfield.operators.evaluate import running_totals
from farfield.operators.knn import edges
from farfield.operators.lsh import neighbours
from farfield.operators.sets import distinct_points, spread_to_copies
from farfield.session import stage


def ratio(top: Column, bottom: Column) -> Column:
    """Division with floating-point results: x/0 is infinite, 0/0 is NaN, never an error."""
    return F.when(
        bottom == 0, F.when(top == 0, F.lit(float("nan"))).otherwise(top * F.lit(float("inf")))
    ).otherwise(F.try_divide(top, bottom))


def density(edge: DataFrame, kdist: DataFrame) -> DataFrame:
    """Local reachability density per point: ``i, lrd``; infinite when all reach is zero."""
    reach = edge.join(kdist.select(F.col("i").alias("j"), "kd"), "j").select(
        "i", reach_distance(F.col("kd"), F.col("dist")).alias("reach")
    )
    total = reach.groupBy("i").agg(F.count("*").alias("m"), F.sum("reach").alias("reach"))
    return total.select("i", ratio(F.col("m").cast("double"), F.col("reach")).alias("lrd"))


def factor(edge: DataFrame, lrd: DataFrame) -> DataFrame:
    """Outlier factor per point: mean density of the neighbours over its own."""
    around = (
        edge.join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("other")), "j")
        .groupBy("i")
        .agg(F.count("*").alias("m"), F.sum("other").alias("around"))
    )
    return around.join(lrd, "i").select(
        "i", "lrd", ratio(F.col("around"), F.col("lrd") * F.col("m")).alias("lof")
    )


def profiles(neighbourhoods: DataFrame) -> DataFrame:
    """``i, n, kd, lrd, lof`` of every point of a *staged* neighbourhood table."""
    edge = edges(neighbourhoods)
    kdist = neighbourhoods.select("i", "kd")
    scored = factor(edge, density(edge, kdist))
    lonely = F.col("n") == 0  # nobody near: infinite density, undefined factor
    return (
        neighbourhoods.select("i", "n", "kd")
        .join(scored, "i", "left")
        .select(
            "i",
            "n",
            "kd",
            F.when(lonely, F.lit(float("inf"))).otherwise(F.col("lrd")).alias("lrd"),
            F.when(lonely, F.lit(float("nan"))).otherwise(F.col("lof")).alias("lof"),
        )
    )


def lof(
    points: DataFrame,
    k: int,
    measure: str | Measure = "euclidean",
    technique: str = "flat",
    hashed: Family | None = None,
) -> DataFrame:
    """Batch LOF over ``points(i, x)``: one row per distinct vector with its profile.

    Copies of a vector count once, under the smallest ``i``; ``spread_to_copies`` hands
    the score to all of them.
    """
    unique = distinct_points(points)
    return profiles(stage(neighbours(unique, k, technique, measure, hashed, stats_of=points), "near"))


def lof_with_points(
    points: DataFrame,
    k: int,
    measure: str | Measure = "euclidean",
    technique: str = "flat",
    hashed: Family | None = None,
) -> DataFrame:
    """Every original row, copies included, with ``n, kd, lrd, lof``."""
    scored = lof(points, k, measure, technique, hashed)
    of_vector = points.select("i", "x").join(scored, "i").drop("i")
    return spread_to_copies(points, of_vector)


def top_outliers(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest factors (NaN above +inf), ties broken by ``i``."""
    return scored.orderBy(F.desc("lof"), "i").limit(n)


def top_inliers(scored: DataFrame, percent: float, rows: int) -> DataFrame:
    """The lowest ``percent`` of factors among ``rows`` points, rounded up.

    The cut grows with the points, so places are counted over ranges instead of gathering
    the short end in one task.
    """
    cut = math.ceil(rows * percent / 100.0)
    placed = running_totals(scored.withColumn("one", F.lit(1)), ["lof", "i"], ["one"])
    return placed.filter(F.col("before_one") < cut).select(*scored.columns).orderBy("lof", "i")


def label_top(scored: DataFrame, n: int) -> DataFrame:
    """Add ``label``: 1 for the top ``n``, else 0.  Joins the short list, ranks nothing."""
    flagged = top_outliers(scored.select("i", "lof"), n).select("i", F.lit(1).alias("label"))
    return scored.join(flagged, "i", "left").withColumn("label", F.coalesce("label", F.lit(0)))
