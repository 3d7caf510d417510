"""One micro-batch of insertions into a scored set of points, touching only what changes.

Given the neighbours of the arriving points and the old points they reach, neighbour
lists are merged, then densities are recomputed where a k-distance or a list changed and
factors where a density changed.  On a set that only grows the result equals batch LOF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.hashing import Family
from farfield.functions.measures import Measure
from farfield.operators.knn import CANDIDATE, NEIGHBOURS, QUERY, edges, keep_nearest, knn_both_ways, knn_within
from farfield.operators.lof import ratio
from farfield.operators.lsh import neighbours
from farfield.operators.sets import first_arrivals
from farfield.session import stage

SCORED = f"i bigint, x array<double>, leaf bigint, kd double, n int, nbrs {NEIGHBOURS}, lrd double, lof double"


def open_reach(k: int) -> Column:
    """How near an arrival must be to enter a list: one that is not full takes any."""
    return F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("kd"))


def find_neighbours(
    old: DataFrame,
    arriving: DataFrame,
    k: int,
    measure: str | Measure,
    technique: str = "flat",
    hashed: Family | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lists of the arriving points, new entries for old points within their k-distance).

    ``technique`` finds the lists of the arrivals; who is reached by them is always exact.
    Of the arrivals only an old point's ``k`` nearest can enter its list, so no list of
    entries is longer, whatever a list that is not full would take.

    Indexes all points anew, which suits a set of bounded size; ``leafindex`` keeps the
    index between batches.
    """
    reaching = old.select("i", "x", open_reach(k).alias("reach"))
    if technique == "flat":
        return knn_both_ways(reaching, arriving, k, measure)
    points = old.select("i", "x", F.lit(CANDIDATE).alias("role")).unionByName(
        arriving.select("i", "x", F.lit(QUERY | CANDIDATE).alias("role"))
    )
    near = neighbours(points, k, technique, measure, hashed).select("i", "nbrs")
    around = reaching.withColumn("role", F.lit(QUERY)).unionByName(
        arriving.select("i", "x", F.lit(CANDIDATE).alias("role"), F.lit(float("inf")).alias("reach"))
    )
    return near, knn_within(around, k, measure)


def owners(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """For each distinct vector that arrived, the point it belongs to: ``x, first, fresh``.

    That is the stored point with these coordinates or, if there is none (``fresh``), the
    earliest arrival.  The stored side is only scanned; the batch is what gets shipped.
    """
    earliest = first_arrivals(arrived.select("i", "x"), "i")
    known = stored.select(F.col("i").alias("stored"), "x").join(earliest.select("x"), "x")
    return stage(
        earliest.join(known, "x", "left").select(
            "x", F.coalesce("stored", "i").alias("first"), F.col("stored").isNull().alias("fresh")
        ),
        "owners",
    )


def _sources_into(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """Points that list one of ``targets(i)`` among their neighbours."""
    into = edges(lists).join(targets.select(F.col("i").alias("j")), "j", "left_semi")
    return into.select("i").distinct()


def insert(
    old: DataFrame,
    arriving: DataFrame,
    near: DataFrame,
    hits: DataFrame,
    k: int,
    virtual: DataFrame | None = None,
) -> DataFrame:
    """Rows of the scored set that are new or changed (schema ``SCORED``).

    ``virtual(j, kd, lrd)`` gives the profile of neighbours that are not points.
    """
    joined = hits.select("i", F.col("nbrs").alias("more")).join(old.select("i", "kd", "nbrs"), "i")
    touched = keep_nearest(
        joined.select(
            "i", F.col("kd").alias("was"), F.array_sort(F.concat("nbrs", "more")).alias("nbrs")
        ),
        k,
    )
    new = keep_nearest(near, k)
    fresh = stage(
        touched.select("i", "kd", "n", "nbrs", (F.col("kd") != F.col("was")).alias("moved")).unionByName(
            new.select("i", "kd", "n", "nbrs", F.lit(True).alias("moved"))
        ),
        "fresh",
    )
    rest = old.join(fresh.select("i"), "i", "left_anti")
    lists = rest.select("i", "kd", "n", "nbrs").unionByName(fresh.drop("moved"))

    # densities: lists that changed, and whoever measures reach against a moved k-distance
    dense_ids = stage(
        _sources_into(rest, fresh.filter("moved")).unionByName(fresh.select("i")).distinct(), "dense"
    )
    kdist = lists.select(F.col("i").alias("j"), "kd")
    if virtual is not None:
        kdist = kdist.unionByName(virtual.select("j", "kd"))
    mine = lists.join(dense_ids, "i", "left_semi")
    reach = edges(mine).join(kdist, "j").groupBy("i").agg(
        F.sum(F.greatest("kd", "dist")).alias("reach"), F.count("*").alias("m")
    )
    lrd = stage(
        dense_ids.join(reach, "i", "left").select(
            "i",
            F.when(F.col("m").isNull(), F.lit(float("inf")))
            .otherwise(ratio(F.col("m").cast("double"), F.col("reach")))
            .alias("lrd"),
        ),
        "lrd",
    )

    # factors: the same points and everyone who lists one of them
    factor_ids = stage(_sources_into(lists, dense_ids).unionByName(dense_ids).distinct(), "factor")
    all_lrd = (
        old.select("i", "lrd").join(lrd.select("i"), "i", "left_anti").unionByName(lrd.select("i", "lrd"))
    )
    looked_up = all_lrd.select(F.col("i").alias("j"), F.col("lrd").alias("other"))
    if virtual is not None:
        looked_up = looked_up.unionByName(virtual.select("j", F.col("lrd").alias("other")))
    mine = lists.join(factor_ids, "i", "left_semi")
    around = edges(mine).join(looked_up, "j").groupBy("i").agg(F.sum("other").alias("around"))
    where = old.select("i", "x", "leaf").unionByName(arriving.select("i", "x", "leaf"))
    return mine.join(around, "i", "left").join(all_lrd, "i").join(where, "i").select(
        "i", "x", "leaf", "kd", "n", "nbrs", "lrd",
        F.when(F.col("n") == 0, F.lit(float("nan")))
        .otherwise(ratio(F.col("around"), F.col("lrd") * F.col("n")))
        .alias("lof"),
    )
