"""Summarized areas: a centre and radius standing for points that were deleted.

An area takes part in neighbour search through virtual points on its rim, two per axis.
They are numbered downwards from -1 by centre, axis and side, so neighbour lists hold
them next to real points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.measures import Measure, resolve, virtual_distance
from farfield.operators.knn import CANDIDATE, NEIGHBOURS, QUERY, edges, within_reach
from farfield.operators.lof import ratio

AREAS = (
    "center bigint, x array<double>, radius double, number bigint, "
    "avg_kd double, avg_lrd double, ts bigint"
)


def virtual_id(center: Column, axis: Column, side: Column, dims: int) -> Column:
    return F.lit(-1).cast("bigint") - (center * (2 * dims) + axis * 2 + side)


def center_of(virtual: Column, dims: int) -> Column:
    return F.floor((F.lit(-1).cast("bigint") - virtual) / F.lit(2 * dims))


def on_rim(areas: DataFrame, dims: int) -> DataFrame:
    """Every area once per axis and side, with its virtual id ``j``."""
    each_axis = F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("axis")
    spread = areas.select("*", each_axis).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return spread.withColumn("j", virtual_id(F.col("center"), F.col("axis"), F.col("side"), dims))


def virtual_points(areas: DataFrame, dims: int) -> DataFrame:
    """Coordinates of the virtual points: the centre moved out (side 0) or back (side 1)
    by the radius along one axis."""
    out = F.when(F.col("side") == 0, F.col("radius")).otherwise(-F.col("radius"))
    moved = F.transform("x", lambda v, a: F.when(a == F.col("axis"), v + out).otherwise(v))
    return on_rim(areas, dims).select("center", "axis", "side", "j", moved.alias("x"))


def virtual_profiles(areas: DataFrame, dims: int) -> DataFrame:
    """``j, kd, lrd`` of every virtual point: the averages of its area."""
    return on_rim(areas, dims).select("j", F.col("avg_kd").alias("kd"), F.col("avg_lrd").alias("lrd"))


def members(areas: DataFrame, points: DataFrame, measure: str | Measure) -> DataFrame:
    """``center, i, dist`` for every point inside an area, rim included."""
    both = areas.select(
        F.col("center").alias("i"), "x", F.lit(QUERY).alias("role"), F.col("radius").alias("reach")
    ).unionByName(
        points.select("i", "x", F.lit(CANDIDATE).alias("role"), F.lit(float("inf")).alias("reach"))
    )
    found = within_reach(both, measure)
    return found.select(F.col("i").alias("center"), F.col("j").alias("i"), "dist")


def centers_near(areas: DataFrame, asking: DataFrame, measure: str | Measure) -> DataFrame:
    """``i, center, dist`` for every area that may have a virtual point within the bound of
    ``asking(i, x, bound)``; the areas that ``i`` lies in are among them.

    A virtual point is at least distance-to-centre minus radius away, so only centres
    within the bound plus the largest radius are looked up.
    """
    largest = areas.agg(F.max("radius").alias("r")).first()["r"] or 0.0
    both = asking.select(
        "i", "x", F.lit(QUERY).alias("role"), (F.col("bound") + F.lit(largest)).alias("reach")
    ).unionByName(
        areas.select(
            F.col("center").alias("i"), "x", F.lit(CANDIDATE).alias("role"),
            F.lit(float("inf")).alias("reach"),
        )
    )
    return within_reach(both, measure).withColumnRenamed("j", "center")


def virtual_neighbours(
    areas: DataFrame, asking: DataFrame, dims: int, measure: str | Measure, k: int, near: DataFrame | None = None
) -> DataFrame:
    """The ``k`` nearest virtual points within the bound of ``asking(i, x, bound)``, ties
    kept: ``i, nbrs``.  ``near`` is what ``centers_near`` gives, if known."""
    near = centers_near(areas, asking, measure) if near is None else near
    rim = on_rim(areas.select("center", "radius"), dims)
    away = virtual_distance(
        F.col("dist"), F.col("radius"), F.col("axis"), F.col("side"), resolve(measure).name
    )
    placed = near.join(rim, "center").select("i", away.alias("dist"), "j").join(
        asking.select("i", "bound"), "i"
    )
    place = F.rank().over(Window.partitionBy("i").orderBy("dist"))
    return (
        placed.filter(F.col("dist") <= F.col("bound"))
        .withColumn("place", place)
        .filter(F.col("place") <= k)
        .groupBy("i")
        .agg(F.collect_list(F.struct("dist", "j")).cast(NEIGHBOURS).alias("nbrs"))
    )


def absorb(areas: DataFrame, joined: DataFrame, clock: int) -> DataFrame:
    """Areas after taking in ``joined(center, dist, kd, lrd)``: averages move by the new
    members' share, the radius shrinks to the closest of them, the age restarts."""
    taken = joined.groupBy("center").agg(
        F.count("*").alias("more"),
        F.sum("kd").alias("sum_kd"),
        F.sum("lrd").alias("sum_lrd"),
        F.min("dist").alias("closest"),
    )
    number = F.col("number") + F.coalesce("more", F.lit(0))
    share = lambda avg, total: F.when(F.col("more").isNull(), F.col(avg)).otherwise(
        (F.col(avg) * F.col("number") + F.col(total)) / number
    )
    return areas.join(taken, "center", "left").select(
        "center", "x",
        F.coalesce("closest", "radius").alias("radius"),
        number.alias("number"),
        share("avg_kd", "sum_kd").alias("avg_kd"),
        share("avg_lrd", "sum_lrd").alias("avg_lrd"),
        F.when(F.col("more").isNull(), F.col("ts")).otherwise(F.lit(clock)).cast("bigint").alias("ts"),
    )


def summarize(scored: DataFrame, centers: DataFrame, clock: int, virtual: DataFrame | None = None) -> DataFrame:
    """New areas around ``centers(i)``: radius is the centre's k-distance, and the averages
    are over its neighbours, virtual ones included."""
    profile = scored.select(F.col("i").alias("j"), F.col("kd").alias("of_kd"), F.col("lrd").alias("of_lrd"))
    if virtual is not None:
        profile = profile.unionByName(
            virtual.select("j", F.col("kd").alias("of_kd"), F.col("lrd").alias("of_lrd"))
        )
    chosen = scored.join(centers.select("i"), "i", "left_semi")
    averages = edges(chosen).join(profile, "j").groupBy("i").agg(
        F.count("*").alias("m"), F.sum("of_kd").alias("kds"), F.sum("of_lrd").alias("lrds")
    )
    none = F.lit(0.0)
    count = F.coalesce("m", F.lit(0))
    return chosen.join(averages, "i", "left").select(
        F.col("i").alias("center"), "x", F.col("kd").alias("radius"),
        (F.col("n") + 1).cast("bigint").alias("number"),
        ratio(F.coalesce("kds", none), count).alias("avg_kd"),
        ratio(F.coalesce("lrds", none), count).alias("avg_lrd"),
        F.lit(clock).cast("bigint").alias("ts"),
    )
