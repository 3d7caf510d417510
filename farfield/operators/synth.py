"""Random vectors and planted neighbours for benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(salt: Column, *parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments: re-run tasks draw the same numbers."""
    return F.pmod(F.xxhash64(salt, *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_vectors(spark: SparkSession, rows: int, dims: int, below: int, seed: int = 0) -> DataFrame:
    """``i, x`` with integer-valued coordinates in [0, below)."""
    draw = lambda j: F.floor(_uniform(F.lit(seed), F.col("id"), j) * below).cast("double")
    return spark.range(rows).select(
        F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), draw).alias("x")
    )


def perturb(x: Column, radius: float, *seeds: Column) -> Column:
    """Move each coordinate by up to ``radius`` either way."""
    return F.transform(
        x, lambda v, j: v + (2 * _uniform(F.lit("move"), j, *seeds) - 1) * F.lit(float(radius))
    )


def with_neighbours(points: DataFrame, copies: int, radius: float, seed: int = 0) -> DataFrame:
    """The points plus ``copies`` perturbed copies of each, under fresh ids."""
    # ids of copies interleave above the originals: i * (copies + 1) + copy
    spread = points.select(
        F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"), "i", "x"
    )
    moved = perturb(F.col("x"), radius, F.lit(seed), F.col("i"), F.col("copy"))
    return spread.select(
        (F.col("i") * (copies + 1) + F.col("copy")).alias("i"),
        F.when(F.col("copy") == 0, F.col("x")).otherwise(moved).alias("x"),
    )
