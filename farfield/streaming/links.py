"""Which stored leaves a micro-batch can touch, told from tables of leaves alone.

Every segment keeps, next to its rows, boxes of its leaves with the largest k-distance in
each (``reach``), boxes of coordinates if those are not (``spans``), and an inverted edge table (``links``): leaf ``by``
holds a point that lists one of leaf ``of``.  The points of a set that only grows never
reach farther than when they were written, and links are only added to, so what older
segments say stays an upper bound; compaction makes it exact again.

Rows of a segment lie in folders by leaf number, hence by place, so that a batch reads the
folders of the leaves it can touch and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.measures import Measure, resolve
from farfield.operators.knn import Leaves, asking_boxes, leaf_pairs, offering_boxes
from farfield.session import stage
from farfield.streaming.insert import SCORED, open_reach
from farfield.streaming.state import Versions

BOXES = "leaf bigint, grp bigint, cls int, lo array<double>, hi array<double>, size bigint, bound double"
LINKS = "of bigint, by bigint"
#: Leaves of a folder, as a power of two: about a million points.
FOLDER_BITS = 10


def folder(leaf: Column) -> Column:
    return F.shiftright(leaf, FOLDER_BITS)


def write_rows(versions: Versions, name: str, batch_id: int, rows: DataFrame) -> str:
    """Write scored rows in folders by leaf; those of a folder that is too much for a task, by several."""
    spread = rows.withColumn("part", folder(F.col("leaf"))).repartitionByRange("leaf", "i")
    return versions.write(name, batch_id, spread, "part")


def rows_of(versions: Versions, segments: list[dict], leaves: DataFrame | None = None) -> DataFrame:
    """The current rows of all leaves, or of ``leaves(leaf)``."""
    only = None
    if leaves is not None:
        # numbers of folders: one for a million points
        parts = [r["part"] for r in leaves.select(folder(F.col("leaf")).alias("part")).distinct().collect()]
        only = F.col("part").isin(parts)
    rows = versions.newest([s["scored"] for s in segments], f"{SCORED}, part bigint", only=only).drop("part")
    return rows if leaves is None else rows.join(leaves, "leaf", "left_semi")


def _plain() -> Measure:
    """Boxes of coordinates, whatever the stream's own measure."""
    return resolve("manhattan")


def describe(
    versions: Versions, suffix: str, batch_id: int, own: DataFrame, listing: DataFrame, known: DataFrame,
    measure: Measure, dims: int, k: int,
) -> dict:
    """Write the tables of leaves of a segment; what the manifest is to say of them.

    ``own`` are the rows of the segment's own leaves, ``listing`` all rows it writes, and
    ``known(i, leaf)`` says where their neighbours lie.
    """
    grp = F.lit(0).cast("bigint").alias("grp")
    reaching = own.select("leaf", grp, "x", open_reach(k).alias("bound"))
    columns = [c.split()[0] for c in BOXES.split(", ")]
    write = lambda name, rows: versions.write(f"{name}{suffix}", batch_id, rows)
    into = listing.select(F.col("leaf").alias("by"), F.explode("nbrs.j").alias("j"))
    into = into.join(known.select(F.col("i").alias("j"), F.col("leaf").alias("of")), "j").filter("of <> by")
    entry = {
        "reach": write("reach", asking_boxes(reaching, measure, dims).select(*columns)),
        "links": write("links", into.select("of", "by").distinct()),
    }
    if measure.box in (None, "unit"):
        entry["spans"] = write("spans", asking_boxes(reaching, _plain(), dims).select(*columns))
    return entry


def _boxes(versions: Versions, segments: list[dict], name: str, dims: int) -> DataFrame:
    """One box for each leaf and class, of what all segments say."""
    each = versions.read([s[name] for s in segments], BOXES)
    return each.groupBy("leaf", "grp", "cls").agg(
        F.array(*(F.min(F.col("lo")[j]) for j in range(dims))).alias("lo"),
        F.array(*(F.max(F.col("hi")[j]) for j in range(dims))).alias("hi"),
        F.sum("size").alias("size"),
        F.max("bound").alias("bound"),
    )


def holding(versions: Versions, segments: list[dict], asked: Leaves, levels: int) -> DataFrame:
    """Leaves in whose boxes some vector of ``asked`` may lie: all that can hold a copy of one."""
    if asked.measure.box == "unit":  # its leaves have boxes of directions
        place = F.expr(f"transform(sequence(0, size(ids) - 1), r -> slice(xs, r * {asked.dims} + 1, {asked.dims}))")
        points = asked.table.select("leaf", "grp", F.explode(place).alias("x"), F.lit(0.0).alias("bound"))
        asking = asking_boxes(points, _plain(), asked.dims)
    else:
        asking = asked.table.select(
            "leaf", "grp", "lo", "hi", F.col("candidates").alias("size"), F.lit(0).alias("cls"), F.lit(0.0).alias("bound")
        )
    spans = _boxes(versions, segments, "spans" if asked.measure.box in (None, "unit") else "reach", asked.dims)
    pairs = leaf_pairs(asking, spans.drop("cls"), levels, _plain(), asked.dims, None)
    return pairs.select(F.col("b").alias("leaf")).distinct()


def touched(
    versions: Versions, segments: list[dict], stored: DataFrame, added: Leaves, near: DataFrame, levels: int, k: int
) -> DataFrame:
    """Leaves whose rows an insertion of ``added``, with lists ``near(i, leaf, x, nbrs)``, reads or changes.

    Those of points reached by an arrival; of whoever lists one of these, whose density moves;
    of whoever lists one of those, whose factor moves; and of the neighbours of all of them.
    """
    measure, dims = added.measure, added.dims
    links = versions.read([s["links"] for s in segments], LINKS)
    asking = _boxes(versions, segments, "reach", dims)
    found = leaf_pairs(asking, offering_boxes(added.table), levels, measure, dims, k)
    some = stage(found.select(F.col("a").alias("leaf")).distinct(), "reached")
    for _ in range(2):
        by = links.join(some.select(F.col("leaf").alias("of")), "of", "left_semi")
        some = some.union(by.select("by")).distinct()
    listed = links.join(some.select(F.col("leaf").alias("by")), "by", "left_semi").select("of")

    far = F.element_at("nbrs", -1)["dist"]
    around = near.filter(F.size("nbrs") > 0).select("leaf", F.lit(0).cast("bigint").alias("grp"), "x", far.alias("bound"))
    used = leaf_pairs(asking_boxes(around, measure, dims), offering_boxes(stored), levels, measure, dims, None)
    return stage(some.union(listed).union(used.select("b")).distinct(), "touched")
