"""LOF over a bounded window: dense regions are summarized, old points age out.

Arrivals are taken in order, in groups of ``step``.  What does not fill a group waits for the
next micro-batch, so that groups, and with them all results, depend on the order of the records
alone, not on when they came.  Rules for a group: find the areas each arrival falls in; insert
all arrivals (see ``insert``), virtual points competing as neighbours; arrivals inside an area
update it and are deleted again; the others stay and advance the logical clock by one each.  If
the window has no room for another group, the most inlying share of it and the neighbours of
those are turned into areas; if it still has none, points and areas past the maximum age are
deleted; then the next group is as large as the room there is.  With ``step=1`` these are the
rules of the strictly ordered stream, at dozens of Spark jobs for each point; larger groups cost
less and leave the window up to a group short of its size.

Deleting a point removes it from its neighbours' lists without refilling them or
recomputing their k-distance; a list that is not full takes the next arrival.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farfield.functions.hashing import Family
from farfield.functions.measures import Measure
from farfield.operators.evaluate import running_totals
from farfield.operators.knn import NEIGHBOURS, edges, k_distance
from farfield.session import passing, stage
from farfield.streaming.areas import (
    AREAS, absorb, center_of, centers_near, summarize, virtual_neighbours, virtual_profiles,
)
from farfield.streaming.ilof import ARRIVALS, write_labels
from farfield.streaming.insert import SCORED, find_neighbours, insert, owners
from farfield.streaming.state import Versions

WINDOW = SCORED + ", ts bigint"
TOP = "i bigint, lof double"
WAITING = "key string, i bigint, x array<double>, place bigint"
LABELS = "key string, label int, reason string"
SAME = 9  # factors that agree in this many decimals are ties, whatever order they were summed in


def rank(lof: str = "lof"):
    """Factors as they are ordered by."""
    return F.round(lof, SAME)


def top_n(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("i", "lof").orderBy(rank().desc(), "i").limit(n)


def delete_rows(window: DataFrame, gone: DataFrame) -> DataFrame:
    """The window without the points ``gone(i)``, also gone from every neighbour list."""
    kept = (
        edges(window)
        .join(gone.select(F.col("i").alias("j")), "j", "left_anti")
        .groupBy("i")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "j"))).alias("kept"))
    )
    left = window.join(gone.select("i"), "i", "left_anti").join(kept, "i", "left")
    lists = F.coalesce("kept", F.array().cast(NEIGHBOURS)).cast(NEIGHBOURS)
    return left.withColumn("nbrs", lists).withColumn("n", F.size("nbrs")).select(*window.columns)


def delete_virtual(window: DataFrame, expired: DataFrame, dims: int) -> DataFrame:
    """The window with the virtual points of expired areas (``center``) gone from its lists."""
    stale = (
        edges(window).filter("j < 0")
        .select("j", center_of(F.col("j"), dims).alias("center")).distinct()
        .join(expired.select("center"), "center", "left_semi")
    )
    return delete_rows(window, stale.select(F.col("j").alias("i")))


@dataclass(frozen=True)
class State:
    """Between two groups.  ``taken`` arrivals have been inserted in ``steps`` groups."""

    window: DataFrame
    areas: DataFrame
    top: DataFrame
    rows: int
    areas_n: int
    clock: int
    taken: int
    steps: int
    owned: list = field(default_factory=list)  # keys and their points, of the groups of this batch
    gone: list = field(default_factory=list)  # points that left in this batch: i, label, reason
    updated: DataFrame | None = None  # points that the last group inserted or changed: i


class WindowedLof:
    """State of one bounded stream under ``root``; ``apply`` is a ``foreachBatch`` function.

    ``window`` is the most points it holds, unless neither rule can make room; ``step`` is a quarter
    of that if not given.  ``trace`` names a folder for what each group leaves: the window, the
    areas, and which points it updated.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        k: int,
        window: int,
        inlier_percent: float,
        max_age: int,
        dims: int,
        top: int = 10,
        measure: str | Measure = "euclidean",
        technique: str = "flat",
        hashed: Family | None = None,
        step: int | None = None,
        trace: str | None = None,
    ):
        self.versions = Versions(spark, root)
        self.spark, self.root, self.measure = spark, root, measure
        self.k, self.size, self.dims, self.top = k, window, dims, top
        self.inlier_percent, self.max_age = inlier_percent, max_age
        self.technique, self.hashed = technique, hashed
        self.step, self.trace = step or max(1, window // 4), trace

    def _manifest(self, batch_id: int | None) -> dict:
        return self.versions.manifest(self.versions.latest() if batch_id is None else batch_id)

    def window(self, batch_id: int | None = None) -> DataFrame:
        return self.versions.read(self._manifest(batch_id).get("window", []), WINDOW)

    def areas(self, batch_id: int | None = None) -> DataFrame:
        return self.versions.read(self._manifest(batch_id).get("areas", []), AREAS)

    def waiting(self, batch_id: int | None = None) -> DataFrame:
        """Arrivals that have not filled a group yet."""
        return self.versions.read(self._manifest(batch_id).get("waiting", []), WAITING)

    def apply(self, batch: DataFrame, batch_id: int, last: bool = False) -> None:
        """Take in a micro-batch; with ``last``, also the arrivals that do not fill a group."""
        before = self.versions.manifest(batch_id - 1)
        with passing(self.spark):
            # a stream's own session has adaptive execution off, so go on in the caller's
            arrived = stage(
                batch.select("key", F.col("seq").alias("i"), "x", F.lit(1).alias("one")), "arrived", self.spark
            )
            seen = before.get("seen", 0)
            placed = running_totals(arrived, ["i", "key"], ["one"]).select(
                "key", "i", "x", (F.col("before_one") + seen).cast("bigint").alias("place")
            )
            waiting = stage(self.versions.read(before.get("waiting", []), WAITING).unionByName(placed), "waiting")
            seen += arrived.count()
            state = self._advanced(self._state(before), waiting, seen, last)
            keys, labels = self._settled(before, state)
            self.versions.log("labels", batch_id, labels)
            write = lambda name, rows: [self.versions.write(name, batch_id, rows)]
            self.versions.commit(
                batch_id,
                {
                    "window": write("window", state.window), "areas": write("areas", state.areas),
                    "top": write("top", state.top), "keys": write("keys", keys),
                    "waiting": write("waiting", waiting.filter(F.col("place") >= state.taken)),
                    "rows": state.rows, "areas_n": state.areas_n, "clock": state.clock, "taken": state.taken,
                    "steps": state.steps, "seen": seen,
                },
            )
        self.versions.collect_garbage(batch_id)

    def _state(self, manifest: dict) -> State:
        read = lambda name, schema: self.versions.read(manifest.get(name, []), schema)
        counts = {n: manifest.get(n, 0) for n in ("rows", "areas_n", "clock", "taken", "steps")}
        return State(read("window", WINDOW), read("areas", AREAS), read("top", TOP), **counts)

    def _advanced(self, state: State, waiting: DataFrame, seen: int, last: bool) -> State:
        """The state after all groups that the waiting arrivals fill."""
        while True:
            room = self.size - state.rows
            take = min(room, self.step) if room > 0 else self.step
            if (left := seen - state.taken) < take and not (last and left):
                return state
            group = waiting.filter(F.col("place").between(state.taken, state.taken + take - 1))
            state = self._grouped(replace(state, taken=min(seen, state.taken + take), steps=state.steps + 1), group)
            if self.trace:
                for name, rows in (("window", state.window), ("areas", state.areas), ("updates", state.updated)):
                    rows.write.mode("overwrite").parquet(f"{self.trace}/{name}/step={state.steps}")

    def _grouped(self, state: State, group: DataFrame) -> State:
        """The state after one group of arrivals."""
        owner = owners(state.window, group)
        owned = [*state.owned, group.join(owner, "x").select("key", F.col("first").alias("i"))]
        fresh = owner.filter("fresh").select(
            F.col("first").alias("i"), "x", F.lit(0).cast("bigint").alias("leaf")
        )
        window, inside, changed, staying = self._insert(state, fresh)
        state = replace(
            state, window=window, owned=owned, rows=state.rows + staying, clock=state.clock + staying, updated=changed.select("i")
        )
        if inside is not None:
            profile = window.select("i", "kd", "lrd")
            areas = stage(absorb(state.areas, inside.join(profile, "i"), state.clock), "areas")
            absorbed = inside.select("i").distinct()
            state = replace(state, areas=areas, window=stage(delete_rows(window, absorbed), "window"), gone=[
                *state.gone, absorbed.select("i", F.lit(0).alias("label"), F.lit("absorbed").alias("reason")),
            ])
        if state.rows + self.step > self.size and self.inlier_percent > 0:
            state = self._summarized(state)
        if state.rows + self.step > self.size:
            state = self._aged(state)
        return state

    def _insert(self, state: State, fresh: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame, int]:
        """The window with all arrivals in it, which lie in which area, the rows that are new or
        changed, and how many arrivals will stay."""
        window, areas = state.window, state.areas
        near, hits = find_neighbours(
            window, fresh, self.k, self.measure, self.technique, self.hashed
        )
        virtual = inside = None
        if state.areas_n:
            virtual = virtual_profiles(areas, self.dims)
            bound = F.when(F.size("nbrs") < self.k, F.lit(float("inf"))).otherwise(
                k_distance(F.col("nbrs"), self.k)
            )
            asking = stage(near.select("i", bound.alias("bound"), "nbrs").join(fresh, "i"), "asking")
            about = stage(centers_near(areas, asking, self.measure), "about")
            inside = stage(
                about.join(areas.select("center", "radius"), "center").filter("dist <= radius").select("center", "i", "dist"),
                "inside",
            )
            rim = virtual_neighbours(areas, asking, self.dims, self.measure, self.k, about)
            near = asking.select("i", "nbrs").join(rim.select("i", F.col("nbrs").alias("rim")), "i", "left")
            near = near.select(
                "i",
                F.when(F.col("rim").isNull(), F.col("nbrs"))
                .otherwise(F.array_sort(F.concat("nbrs", "rim")))
                .alias("nbrs"),
            )
        changed = stage(insert(window, fresh, near, hits, self.k, virtual), "changed")
        staying = fresh.select("i")
        if inside is not None:
            staying = staying.join(inside.select("i"), "i", "left_anti")
        stamps = running_totals(staying.withColumn("one", F.lit(1)), ["i"], ["one"]).select(
            "i", (F.col("before_one") + state.clock).cast("bigint").alias("ts")
        )
        stamps = window.select("i", "ts").unionByName(stamps)
        untouched = window.drop("ts").join(changed.select("i"), "i", "left_anti")
        whole = untouched.unionByName(changed).join(stamps, "i", "left")
        return stage(whole, "window"), inside, changed, staying.count()

    def _summarized(self, state: State) -> State:
        window, areas = state.window, state.areas
        cut = min(state.rows, math.ceil(state.rows * self.inlier_percent / 100.0))
        ranked = window.select(rank().alias("rank"), "i", F.lit(1).alias("one"))
        placed = running_totals(ranked, ["rank", "i"], ["one"])
        centers = stage(placed.filter(F.col("before_one") < cut).select("i"), "centers")
        made = summarize(window, centers, state.clock, virtual_profiles(areas, self.dims))
        around = edges(window.join(centers, "i", "left_semi")).select(F.col("j").alias("i"))
        doomed = stage(centers.unionByName(around).distinct(), "doomed")
        left = stage(delete_rows(window, doomed), "window")
        areas = stage(areas.unionByName(made.select(*areas.columns)), "areas")
        gone = doomed.filter("i >= 0").select("i", F.lit(0).alias("label"), F.lit("summarized").alias("reason"))
        return replace(
            state, window=left, areas=areas, rows=left.count(), areas_n=state.areas_n + cut, gone=[*state.gone, gone]
        )

    def _aged(self, state: State) -> State:
        old = F.lit(state.clock) - F.col("ts") > self.max_age
        aged = stage(state.window.filter(old).select("i", "lof"), "aged")
        expired = stage(state.areas.filter(old).select("center"), "expired")
        best = stage(top_n(state.top.unionByName(aged), self.top), "top")
        left = stage(delete_virtual(delete_rows(state.window, aged), expired, self.dims), "window")
        areas = stage(state.areas.join(expired, "center", "left_anti").select(*state.areas.columns), "areas")
        hits = best.select("i", F.lit(1).alias("hit"))
        gone = aged.select("i").join(hits, "i", "left").select(
            "i", F.coalesce("hit", F.lit(0)).alias("label"), F.lit("aged").alias("reason")
        )
        return replace(
            state, window=left, areas=areas, top=best, rows=state.rows - aged.count(), areas_n=areas.count(),
            gone=[*state.gone, gone],
        )

    def _settled(self, before: dict, state: State) -> tuple[DataFrame, DataFrame]:
        """Keys of the points still in the window, and the labels of those that left it."""
        none = self.spark.createDataFrame([], "i bigint, label int, reason string")
        keys = reduce(DataFrame.unionByName, state.owned, self.versions.read(before.get("keys", []), ARRIVALS))
        gone = stage(reduce(DataFrame.unionByName, state.gone, none), "gone")
        return keys.join(gone, "i", "left_anti").select("key", "i"), keys.join(gone, "i").select("key", "label", "reason")

    def labels(self) -> DataFrame:
        """All labels so far: ``key, label, reason``, as if the stream ended here.

        Arrivals that have not filled a group are taken in for that, but not kept.  Points still
        in the window are labelled ``final`` against the top outliers including the aged ones.
        """
        last = self.versions.latest()
        emitted = self.versions.logged("labels", LABELS, last).select("key", "label", "reason")
        return emitted.unionByName(self._closing())

    def _closing(self) -> DataFrame:
        """Labels of the points that have none yet, were the stream to end now."""
        manifest = self._manifest(None)
        state = self._advanced(
            self._state(manifest), self.versions.read(manifest.get("waiting", []), WAITING), manifest.get("seen", 0), True
        )
        keys, labels = self._settled(manifest, state)
        hits = top_n(state.top.unionByName(state.window.select("i", "lof")), self.top).select("i", F.lit(1).alias("hit"))
        final = keys.join(hits, "i", "left").select(
            "key", F.coalesce("hit", F.lit(0)).alias("label"), F.lit("final").alias("reason")
        )
        return labels.unionByName(final)

    def start(
        self, points: DataFrame, checkpoint: str, sink: str | None = None, total_points: int | None = None
    ) -> StreamingQuery:
        """Run over a stream of ``key, seq, x`` until its data is used up.

        With ``sink``, every batch writes the labels of the points that left the window, and
        why.  The others get theirs when ``total_points`` have been seen, or from ``finish``
        when the stream has ended.
        """

        def step(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id)
            if sink:
                left = self.versions.logged("labels", LABELS, batch_id).filter(F.col("batch") == batch_id)
                write_labels(left, sink, f"left-{batch_id}", batch_id)
            if sink and total_points is not None and self._manifest(batch_id)["seen"] >= total_points:
                self.finish(sink)

        return (
            points.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def finish(self, sink: str) -> None:
        """Write the labels that ``labels`` adds at the end; writing again replaces them."""
        with passing(self.spark):
            write_labels(self._closing(), sink, "final", self.versions.latest())
