"""Incremental LOF: scores of everything seen so far, kept current batch by batch.

The state is a list of segments, each written once: the rows a batch added or changed, the
leaves of the points it added, tables of leaves that say which of them a later batch can touch
and, with a hash technique, buckets.  A batch searches only the stored leaves near its own points
or the buckets they share, reads the rows of the leaves it can touch, and writes what changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farfield.functions.hashing import Family
from farfield.functions.measures import Measure
from farfield.operators.knn import LEAF_ROWS, LEAF_SCHEMA, Leaves, build_leaves
from farfield.operators.lof import label_top
from farfield.operators.lsh import TECHNIQUES, first_k
from farfield.operators.sets import first_arrivals
from farfield.session import passing, stage
from farfield.streaming import buckets, leafindex, links
from farfield.streaming.insert import insert, owners
from farfield.streaming.state import Versions

ARRIVALS = "key string, i bigint"
COLUMNS = ["i", "x", "leaf", "kd", "n", "nbrs", "lrd", "lof"]
COMPACT_AFTER = 8


class IncrementalLof:
    """State of one stream under ``root``; ``apply`` is a ``foreachBatch`` function.

    The state after the last two batches can be read; older segments are deleted.
    Points are told apart by coordinates: a copy of a known point changes no score, and
    its key gets the label of the first arrival.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        k: int,
        measure: str | Measure = "euclidean",
        technique: str = "flat",
        hashed: Family | None = None,
        leaf_rows: int = LEAF_ROWS,
    ):
        self.leaf_rows = leaf_rows
        self.versions = Versions(spark, root)
        self.spark, self.k, self.measure = spark, k, measure
        self.technique, self.hashed = technique.lower(), hashed
        if self.technique not in TECHNIQUES:
            raise ValueError(f"unknown technique {technique!r}; known: {', '.join(TECHNIQUES)}")
        if self.technique in ("planes", "tables") and hashed is None:
            raise ValueError(f"technique {technique!r} needs a hash family")

    def scores(self, batch_id: int | None = None) -> DataFrame:
        """``i, x, kd, n, nbrs, lrd, lof`` after a batch (the last one by default)."""
        manifest = self.versions.manifest(self.versions.latest() if batch_id is None else batch_id)
        return self._overlaid(manifest.get("segments", []))

    def profiles(self, batch_id: int | None = None) -> DataFrame:
        """Each point's whole profile after a batch, a row per neighbour: ``i, x, n, kd, lrd,
        lof`` and ``j, dist, reach``; points without neighbours have one row of nulls."""
        scored = stage(self.scores(batch_id), "scored")
        each = scored.select("i", "x", "n", "kd", "lrd", "lof", F.explode_outer("nbrs").alias("e"))
        kd_of = scored.select(F.col("i").alias("j"), F.col("kd").alias("kd_j"))
        return each.select("*", "e.j", "e.dist").join(kd_of, "j", "left").select(
            "i", "x", "n", "kd", "lrd", "lof", "j", "dist", F.when(F.col("j").isNotNull(), F.greatest("kd_j", "dist")).alias("reach")
        )

    def arrivals(self, batch_id: int | None = None) -> DataFrame:
        return self.versions.logged("arrivals", ARRIVALS, self.versions.latest() if batch_id is None else batch_id)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        with passing(self.spark):
            self._apply(batch, batch_id)
        self.versions.collect_garbage(batch_id)

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        before = self.versions.manifest(batch_id - 1)
        segments = before.get("segments", [])
        # a stream's own session has adaptive execution off, so go on in the caller's
        arrived = stage(batch.select("key", F.col("seq").alias("i"), "x"), "arrived", self.spark)
        earliest = stage(first_arrivals(arrived.select("i", "x"), "i"), "earliest")
        made = self._packed(earliest)
        holding = links.rows_of(
            self.versions, segments, links.holding(self.versions, segments, made, leafindex.levels(segments, made))
        ) if segments else self._overlaid([])
        owner = owners(holding, earliest)
        self.versions.log("arrivals", batch_id, arrived.join(owner, "x").select("key", F.col("first").alias("i")))

        fresh = owner.filter("fresh").select(F.col("first").alias("i"), "x")
        if not owner.filter(~F.col("fresh")).isEmpty():
            made = self._packed(fresh)
        added = leafindex.build(self.versions, batch_id, made)
        levels = leafindex.levels(segments, added.leaves)
        entry = {**added.entry, "rows": added.leaves.rows}
        leaves = self._leaves(segments)
        if self.technique in ("flat", "kd"):
            near = leafindex.find(leaves, segments, added, self.k)
            if self.technique == "kd":
                near = first_k(near, self.k)
        else:
            probe = self.technique == "planes"
            entry |= buckets.build(self.versions, batch_id, fresh, entry["rows"], self.hashed, probe)
            near = buckets.find(self.versions, segments, entry, fresh, self.k, self.measure, self.hashed, probe)
        near = stage(near, "near")
        arriving = fresh.join(added.where, "i")
        old, hits = self._overlaid([]), near.limit(0)
        if segments:
            touched = links.touched(
                self.versions, segments, leaves, added.leaves, near.join(arriving, "i"), levels, self.k
            )
            old = stage(links.rows_of(self.versions, segments, touched), "old")
            hits = leafindex.reached(old, segments, added, self.k)
        changed = insert(old, arriving, near, hits, self.k)
        scored = links.write_rows(self.versions, "scored", batch_id, changed)
        changed = links.rows_of(self.versions, [{"scored": scored}])
        known = old.select("i", "leaf").unionByName(added.where)
        own = changed.filter(F.col("leaf") >= added.entry["floor"])
        entry |= links.describe(
            self.versions, "", batch_id, own, changed, known, made.measure, made.dims, self.k
        )
        segments = [*segments, {"scored": scored, **entry}]
        self.versions.commit(
            batch_id,
            {
                "segments": self._compacted(segments, batch_id),
                "seen": before.get("seen", 0) + arrived.count(),
                "read": old.count(),
            },
        )

    def _packed(self, points: DataFrame) -> Leaves:
        return build_leaves(points, self.measure, self.leaf_rows)

    def _overlaid(self, segments: list[dict]) -> DataFrame:
        return links.rows_of(self.versions, segments).select(*COLUMNS)

    def _leaves(self, segments: list[dict]) -> DataFrame:
        return self.versions.read([s["leaves"] for s in segments], LEAF_SCHEMA)

    def _compacted(self, segments: list[dict], batch_id: int) -> list[dict]:
        """Few segments: once there are many, the newer ones become one, and all of them
        once the newer ones add up to a quarter of the first.  So a point is rewritten
        a few times over its life, not once per batch."""
        if len(segments) <= COMPACT_AFTER:
            return segments
        newer = sum(s["rows"] for s in segments[1:])
        keep = 1 if newer * 4 < segments[0]["rows"] else 0
        merged = segments[keep:]
        rows = stage(self._overlaid(merged), "merged")
        own = rows.filter(F.col("leaf") >= merged[0]["floor"])
        index = leafindex.build(self.versions, batch_id, self._packed(own.select("i", "x")), compacting=True)
        moved = rows.join(index.where.withColumnRenamed("leaf", "moved"), "i", "left")
        moved = moved.withColumn("leaf", F.coalesce("moved", "leaf")).drop("moved")
        scored = links.write_rows(self.versions, "scored-merged", batch_id, moved.select(*rows.columns))
        moved = links.rows_of(self.versions, [{"scored": scored}])
        known = index.where.select("i", "leaf")
        if keep:  # neighbours that did not move
            before = F.col("leaf") < merged[0]["floor"]
            of = self.versions.read([s["links"] for s in merged], links.LINKS).select(F.col("of").alias("leaf"))
            at = stage(of.union(rows.select("leaf")).filter(before).distinct(), "unmoved")
            known = known.unionByName(links.rows_of(self.versions, segments[:keep], at).select("i", "leaf"))
        entry = {"scored": scored, **index.entry, "rows": index.leaves.rows}
        new = moved.filter(F.col("leaf") >= index.entry["floor"])
        entry |= links.describe(
            self.versions, "-merged", batch_id, new, moved, known, index.leaves.measure, index.leaves.dims, self.k
        )
        if self.technique in ("planes", "tables"):
            entry |= buckets.merge(self.versions, batch_id, merged)
        return [*segments[:keep], entry]

    def labels(self, top_n: int) -> DataFrame:
        """``key, label`` of every arrival: 1 for the keys of the ``top_n`` points."""
        flagged = label_top(self.scores().select("i", "lof"), top_n).select("i", "label")
        return self.arrivals().join(flagged, "i").select("key", "label")

    def start(
        self,
        points: DataFrame,
        checkpoint: str,
        sink: str | None = None,
        top_n: int = 10,
        total_points: int | None = None,
    ) -> StreamingQuery:
        """Run over a stream of ``key, seq, x`` until its data is used up.

        With ``sink``, labels are written there when ``total_points`` have been seen.
        """

        def step(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id)
            manifest = self.versions.manifest(batch_id)
            if sink and total_points is not None and manifest["seen"] >= total_points:
                final = self.labels(top_n).withColumn("reason", F.lit("final"))
                write_labels(final, sink, "final", batch_id)

        return (
            points.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def write_labels(labels: DataFrame, sink: str, part: str, batch_id: int) -> None:
    """Label rows ``key, label, reason, batch_id``; a part that is written again is replaced."""
    labels.select("key", "label", "reason").withColumn("batch_id", F.lit(batch_id)).write.mode(
        "overwrite"
    ).parquet(f"{sink}/part={part}")
