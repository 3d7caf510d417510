"""The leaf tables of a growing set, kept between micro-batches.

Every batch packs its own points into leaves and adds them; leaf numbers of a segment
start at its ``floor``, above all earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.operators.knn import (
    Leaves, asking_boxes, bound_class, leaf_pairs, offering_boxes, search_away, search_home, search_in_rounds,
)
from farfield.session import arrow_rows, stage
from farfield.streaming.insert import open_reach
from farfield.streaming.state import Versions

FLOOR_BITS = 39


@dataclass(frozen=True)
class Added:
    leaves: Leaves
    entry: dict  # path, floor and levels, for the manifest

    @property
    def where(self) -> DataFrame:
        """``i, leaf`` of every point."""
        return self.leaves.table.select(F.explode("ids").alias("i"), "leaf")


def build(versions: Versions, batch_id: int, made: Leaves, compacting: bool = False) -> Added:
    """Add leaves that ``build_leaves`` made."""
    floor = (2 * (batch_id + 1) + int(compacting)) << FLOOR_BITS
    path = versions.write(
        "leaves-merged" if compacting else "leaves", batch_id, made.table.withColumn("leaf", F.col("leaf") + floor)
    )
    table = versions.read([path], made.table.schema)
    leaves = Leaves(
        table, made.measure, made.dims, made.leaf_rows, made.rows, made.mean_rows, made.levels, made.split
    )
    return Added(leaves, {"leaves": path, "floor": floor, "levels": made.levels})


def levels(segments: list[dict], leaves: Leaves) -> int:
    return max([leaves.levels, *(s["levels"] for s in segments)])


def find(stored: DataFrame, segments: list[dict], added: Added, k: int) -> DataFrame:
    """Exact lists ``i, nbrs`` of the added points."""
    new = added.leaves
    everywhere = stored.unionByName(new.table)
    with arrow_rows(new.spark, new.batch_rows):
        home = stage(search_home(new, k, True, keep_x=True), "home")
    asking = asking_boxes(home, new.measure, new.dims)
    pairs = leaf_pairs(asking, offering_boxes(everywhere), levels(segments, new), new.measure, new.dims, k)
    near = search_in_rounds(home, pairs, everywhere, new.measure, new.dims, k, True, new.batch_rows)
    return near.select("i", "nbrs")


def reached(old: DataFrame, segments: list[dict], added: Added, k: int) -> DataFrame:
    """New entries ``i, nbrs`` for old points: the added ones within their k-distance."""
    new = added.leaves
    reaching = old.select("i", "leaf", F.lit(0).cast("bigint").alias("grp"), "x", open_reach(k).alias("bound"))
    reaching = reaching.withColumn("cls", bound_class(F.col("bound")))
    asking = asking_boxes(reaching, new.measure, new.dims)
    back = leaf_pairs(asking, offering_boxes(new.table), levels(segments, new), new.measure, new.dims, k)
    hits = search_away(reaching, back, new.table, new.measure, new.dims, k, True, new.batch_rows)
    return hits.groupBy("i").agg(F.array_sort(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
