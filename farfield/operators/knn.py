"""Exact k-nearest-neighbour join without emitting pairs.

Points are laid along a space-filling curve, range-partitioned, and packed into
leaves: one row holds at most ``leaf_rows`` points together with their bounding box.
Each leaf answers its own points first; a point then visits only those other leaves
whose box is no farther than the k-th distance it already has, the nearest ones in a round
of their own, after which that distance is smaller.  Box pairs are found top-down over a
hierarchy of boxes with equi-joins, so no step compares everything with everything.  All
work units are bounded, hot regions and hot groups included.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.measures import Measure, resolve
from farfield.operators import blocks
from farfield.session import arrow_rows, stage

LEAF_ROWS = 1024
BATCH_BYTES = 256 << 20
FANOUT_BITS = 5
CURVE_BINS = 64
CURVE_DIMS = 8  # coordinates that lay out the curve: those that spread widest
CURVE_BITS = 48
FIRST_VISITS = 3  # leaves visited in the first round
TILE_BITS = 3  # least leaves on a side of a tile, as a power of two
TILE_BYTES = 256 << 20  # most bytes of vectors on a side of a tile
UNROLLED_DIMS = 16  # with more coordinates, box distances loop and blocks are screened

QUERY, CANDIDATE = 1, 2
STORED = 4  # neither, until a search gives it a role

LEAF_SCHEMA = (
    "leaf bigint, grp bigint, queries int, candidates int, ids array<bigint>, xs array<double>, "
    "roles array<int>, reaches array<double>, lo array<double>, hi array<double>"
)
NEIGHBOURS = "array<struct<dist: double, j: bigint>>"


@dataclass(frozen=True)
class Leaves:
    """The staged leaf table and what was learned while writing it."""

    table: DataFrame
    measure: Measure
    dims: int
    leaf_rows: int
    rows: int
    mean_rows: float  # points in an average leaf: small when groups are small
    levels: int
    split: bool  # some group spans several leaves
    most: int = 1  # leaves of the largest group

    @property
    def tiled(self) -> bool:
        """Whether boxes tell little apart, so that nearly every leaf is near nearly every other."""
        return self.measure.box is None or self.dims > UNROLLED_DIMS

    @property
    def batch_rows(self) -> int:
        """Leaves per Arrow batch: about 32k points, and within bounds if all were full."""
        wanted = 32 * LEAF_ROWS / max(1.0, self.mean_rows)
        bound = BATCH_BYTES / (self.leaf_rows * 8 * (self.dims + 4))
        return max(1, int(min(wanted, bound)))

    @property
    def spark(self):
        return self.table.sparkSession


def _prepare(points: DataFrame) -> DataFrame:
    have = set(points.columns)
    return points.select(
        F.col("grp").cast("bigint") if "grp" in have else F.lit(0).cast("bigint").alias("grp"),
        F.col("i").cast("bigint").alias("i"),
        F.col("x").cast("array<double>").alias("x"),
        F.col("role").cast("int") if "role" in have else F.lit(QUERY | CANDIDATE).alias("role"),
        F.col("reach").cast("double") if "reach" in have else F.lit(float("inf")).alias("reach"),
    )


def _curve_position(cuts: list[list[float]], axes: list[int]) -> list[tuple[str, Column]]:
    """Columns r0..rm (fine rank of each coordinate of ``axes``) and z (their bits interleaved).

    A rank is the coordinate's place under its piecewise-linear distribution, so dense
    and sparse regions get curve length in proportion to the points they hold.
    """
    turns = _split_order(cuts)
    bits = max(turns.count(m) for m in range(len(cuts)))
    steps = ",".join(str(CURVE_BINS >> (s + 1)) for s in range(int(math.log2(CURVE_BINS))))
    columns = []
    for m, (axis, edge) in enumerate(zip(axes, cuts)):
        c = "array(" + ",".join(f"{v!r}D" for v in edge) + ")"
        bin_ = f"aggregate(array({steps}), 0, (p, s) -> if({c}[p + s] <= x[{axis}], p + s, p))"
        columns.append((f"b{m}", F.expr(bin_)))
        inside = (
            f"if({c}[b{m} + 1] > {c}[b{m}], "
            f"least(greatest((x[{axis}] - {c}[b{m}]) / ({c}[b{m} + 1] - {c}[b{m}]), 0D), 1D), 0D)"
        )
        top = (1 << bits) - 1
        columns.append(
            (f"r{m}", F.expr(f"least(cast((b{m} + {inside}) / {CURVE_BINS}D * {1 << bits} as bigint), {top}L)"))
        )
    woven = [
        f"shiftleft(shiftright(r{m}, {bits - 1 - turns[:place].count(m)}) & 1L, {CURVE_BITS - 1 - place})"
        for place, m in enumerate(turns)
    ]
    columns.append(("z", F.expr(" | ".join(woven))))
    return columns


def _split_order(cuts: list[list[float]]) -> list[int]:
    """Which coordinate each bit of the curve halves: always the one still widest.

    Cells stay close to cubes in distance units, so a narrow coordinate (a code, a
    flag) is not cut before it matters.
    """
    widths = [edge[-4] - edge[3] or edge[-1] - edge[0] for edge in cuts]
    turns = []
    for _ in range(CURVE_BITS):
        widest = max(range(len(cuts)), key=widths.__getitem__)
        turns.append(widest)
        widths[widest] /= 2
    return turns


def _widest(sample: DataFrame, dims: int) -> list[int]:
    """Up to ``CURVE_DIMS`` coordinates, in order: those with the largest deviations."""
    if dims <= CURVE_DIMS:
        return list(range(dims))
    # a row per coordinate: an aggregate per coordinate would make ``x`` anew for each of them
    spread = sample.select(F.posexplode("x").alias("m", "v")).groupBy("m").agg(F.stddev_pop("v").alias("size")).collect()
    known = {r["m"]: r["size"] for r in spread if r["size"] is not None and not math.isnan(r["size"])}
    size = [known.get(m, 0.0) for m in range(dims)]
    return sorted(sorted(range(dims), key=lambda m: (-size[m], m))[:CURVE_DIMS])


def build_leaves(
    points: DataFrame,
    measure: str | Measure = "euclidean",
    leaf_rows: int = LEAF_ROWS,
    stats_of: DataFrame | None = None,
) -> Leaves:
    """Pack ``points(i, x[, grp, role, reach])`` into the staged leaf table.

    ``stats_of`` may name a cheaper table with the same ``x`` distribution (say, the
    scan below a dedup) for the count and the quantiles.
    """
    measure = resolve(measure)
    spark = points.sparkSession
    source = _prepare(points)
    sample = source if stats_of is None else _prepare(stats_of)
    extent = sample.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    rows, dims = extent["n"], extent["d"] or 1
    pack = blocks.pack_leaves(dims, leaf_rows, measure.box == "unit")
    partitions = math.ceil(
        min(
            max(1, rows / leaf_rows),
            max(spark.sparkContext.defaultParallelism, rows / (256 * leaf_rows)),
        )
    )
    key = ["grp", "z", "i"]
    spread = source.withColumn("z", F.lit(0))
    if rows:
        axes = _widest(sample, dims)
        shares = [q / CURVE_BINS for q in range(CURVE_BINS + 1)]
        cuts = sample.agg(
            *(F.percentile_approx(F.col("x")[m], shares, 1000).alias(f"q{m}") for m in axes)
        ).first()
        for name, column in _curve_position(list(cuts), axes):
            spread = spread.withColumn(name, column)
    spread = spread.select(*key, "x", "role", "reach")
    spread = spread.repartitionByRange(partitions, *key) if partitions > 1 else spread.repartition(1)
    spread = spread.sortWithinPartitions(*key).drop("z")
    table = stage(spread.mapInArrow(pack, LEAF_SCHEMA), "leaves")
    low_bits = F.col("leaf").bitwiseAND(F.lit(0xFFFFFFFF))
    shape = (
        table.groupBy("grp")
        .agg(F.count("*").alias("leaves"), F.max(low_bits).alias("high"))
        .agg(F.sum("leaves").alias("all"), F.max("leaves").alias("most"), F.max("high").alias("high"))
        .first()
    )
    most, high = shape["most"] or 1, shape["high"] or 0
    width = max(1, int(high).bit_length())
    dense = F.expr(f"shiftleft(shiftright(leaf, 32), {width}) | (leaf & {0xFFFFFFFF}L)")
    table = table.withColumn("leaf", dense)
    levels = max(0, math.ceil(math.log2(max(1, most)) / FANOUT_BITS) - 1)
    return Leaves(table, measure, dims, leaf_rows, rows, rows / (shape["all"] or 1), levels, most > 1, most)


def _box_distance(kind: str, dims: int, far: bool, a: tuple[str, str], b: tuple[str, str]) -> str:
    """SQL for the least (or, if ``far``, greatest) distance between two boxes.

    Terms are added in coordinate order like the distances themselves; rounding is
    monotone, so a bound is never on the wrong side of a distance it bounds.
    """
    (alo, ahi), (blo, bhi) = a, b
    if dims > UNROLLED_DIMS:
        apart = lambda p, q: f"zip_with({p}, {q}, (p, q) -> p - q)"
        gaps = (
            f"zip_with({apart(ahi, blo)}, {apart(bhi, alo)}, (u, v) -> greatest(u, v))" if far else
            f"zip_with({apart(alo, bhi)}, {apart(blo, ahi)}, (u, v) -> greatest(u, v, 0D))"
        )
        total = f"aggregate({gaps}, 0D, (s, g) -> s + {'g' if kind == 'l1' else 'g * g'})"
    else:
        terms = []
        for j in range(dims):
            if far:
                gap = f"greatest({ahi}[{j}] - {blo}[{j}], {bhi}[{j}] - {alo}[{j}])"
            else:
                gap = f"greatest({alo}[{j}] - {bhi}[{j}], {blo}[{j}] - {ahi}[{j}], 0D)"
            terms.append(gap if kind == "l1" else f"{gap} * {gap}")
        total = " + ".join(["0D", *terms])
    if kind == "l2":
        return f"sqrt({total})"
    if kind == "unit":  # 1 - cos = half the squared chord; slack for the unit vectors' rounding
        return f"({total}) / 2 {'+' if far else '-'} 1e-9D"
    return total


def _level(boxes: DataFrame, up: int, dims: int, *by: str) -> DataFrame:
    """Boxes of the hierarchy ``up`` levels above the leaves."""
    node = F.shiftright("leaf", FANOUT_BITS * up).alias("node")
    parent = F.shiftright("leaf", FANOUT_BITS * (up + 1)).alias("parent")
    if up == 0:
        return boxes.select(node, parent, "grp", *by, "lo", "hi", "size", "bound")
    return boxes.groupBy("grp", node, parent, *by).agg(
        F.array(*(F.min(F.col("lo")[j]) for j in range(dims))).alias("lo"),
        F.array(*(F.max(F.col("hi")[j]) for j in range(dims))).alias("hi"),
        F.sum("size").alias("size"),
        F.max("bound").alias("bound"),
    )


def bound_class(bound: Column) -> Column:
    """Bounds of one class differ by less than a factor of two; none yet is a class too."""
    return (
        F.when(bound.isNull() | (bound == float("inf")), F.lit(9999))
        .when(bound <= 0, F.lit(-9999)).otherwise(F.floor(F.log2(bound)).cast("int"))
    )


def _unit(x: str) -> Column:
    return F.expr(f"transform({x}, v -> try_divide(v, sqrt(aggregate({x}, 0D, (s, v) -> s + v * v))))")


def asking_boxes(points: DataFrame, measure: Measure, dims: int) -> DataFrame:
    """Boxes around the query points ``leaf, grp, x, bound``, one for each leaf and class of bounds.

    A point far from all others opens its own box only, not the whole leaf.
    """
    at = points.select(
        "leaf", "grp", bound_class(F.col("bound")).alias("cls"), "bound",
        (_unit("x") if measure.box == "unit" else F.col("x")).alias("x"),
    )
    edges_ = [] if measure.box is None else [
        F.array(*(f(F.col("x")[j]) for j in range(dims))).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))
    ]
    boxes = at.groupBy("leaf", "grp", "cls").agg(*edges_, F.count("*").alias("size"), F.max("bound").alias("bound"))
    return boxes if edges_ else boxes.select("*", F.lit(None).cast("array<double>").alias("lo"), F.lit(None).cast("array<double>").alias("hi"))


def offering_boxes(table: DataFrame) -> DataFrame:
    """Boxes of the leaves that hold candidates."""
    return table.filter("candidates > 0").select(
        "leaf", "grp", "lo", "hi", F.col("candidates").alias("size"), F.lit(None).cast("double").alias("bound")
    )


def leaf_pairs(
    asking: DataFrame, offering: DataFrame, levels: int, measure: Measure, dims: int, k: int | None
) -> DataFrame:
    """``a, cls, b``: different leaves of one group such that some point of that class in ``a``
    may have neighbours in ``b``, found from the top of the box hierarchy down; with the box
    of ``b`` and ``turn``, its place by distance."""
    kind, pairs = measure.box, None
    near = F.lit(0.0)
    for up in range(levels, -1, -1):
        a = _level(asking, up, dims, "cls").select(
            F.col("node").alias("a"), F.col("parent").alias("pa"), "grp", "cls",
            F.col("lo").alias("alo"), F.col("hi").alias("ahi"), "bound",
        )
        b = _level(offering, up, dims).select(
            F.col("node").alias("b"), F.col("parent").alias("pb"), "grp",
            F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("size").alias("offered"),
        )
        if pairs is None:
            pairs = a.join(b, "grp")
        else:
            above = pairs.select(F.col("a").alias("pa"), "cls", F.col("b").alias("pb"), "grp")
            pairs = above.join(a, ["grp", "pa", "cls"]).join(b, ["grp", "pb"])
        if kind is not None:
            near = F.expr(_box_distance(kind, dims, False, ("alo", "ahi"), ("blo", "bhi")))
            allowed = F.col("bound")
            if k is not None:
                # A leaf short of k candidates of its own has no bound yet: any box that
                # holds enough of them bounds it by the farthest corner.
                far = F.expr(_box_distance(kind, dims, True, ("alo", "ahi"), ("blo", "bhi")))
                enough = F.min(F.when(F.col("offered") > k, far)).over(Window.partitionBy("grp", "a", "cls"))
                pairs = pairs.withColumn("enough", enough)
                allowed = F.least(allowed, F.col("enough"))
            pairs = pairs.withColumn("near", near).filter(F.col("near") <= allowed)
    if kind is None:
        pairs = pairs.withColumn("near", near)
    turn = F.row_number().over(Window.partitionBy("grp", "a", "cls").orderBy("near", "b"))
    return pairs.filter("a <> b").select("a", "cls", "b", "blo", "bhi", turn.alias("turn"))


def _kernel(measure: Measure, dims: int):
    if measure.rows is None:
        raise ValueError(f"measure {measure.name!r} has no array form")
    if dims > UNROLLED_DIMS and measure.screen is not None:
        return blocks.screened(measure)
    return blocks.exact(measure)


def _pairs(measure: Measure, dims: int):
    """Distances of rows of points, as the kernel takes them; infinite where there is none."""
    rows, key, unkey = measure.rows, measure.key, measure.unkey
    if dims <= UNROLLED_DIMS or measure.screen is None:
        rows = lambda a, b: unkey(key(a, b))

    def distance(a, b):
        dist = rows(a, b)
        dist[np.isnan(dist)] = np.inf
        return dist

    return distance


def search_home(leaves: Leaves, k: int | None, skip_self: bool, keep_x: bool) -> DataFrame:
    """Each query point with its neighbours in its own leaf and the bound that leaves."""
    table = leaves.table.select("leaf", "grp", "ids", "xs", "roles", "reaches")
    return table.mapInArrow(
        blocks.within_leaf(
            _kernel(leaves.measure, leaves.dims), _pairs(leaves.measure, leaves.dims), leaves.dims, k, skip_self, keep_x
        ),
        f"i bigint, leaf bigint, grp bigint, bound double, nbrs {NEIGHBOURS}"
        + (", x array<double>" if keep_x else ""),
    )


def search_away(
    points: DataFrame,
    pairs: DataFrame,
    hosts: DataFrame,
    measure: Measure,
    dims: int,
    k: int | None,
    skip_self: bool,
    batch_rows: int,
) -> DataFrame:
    """Neighbours of ``points(i, leaf, cls, x, bound)`` in the other leaves of ``pairs``, staged.

    Only points whose own distance to the other leaf's box is within their bound travel.
    """
    visits = points.select("i", F.col("leaf").alias("a"), "cls", "x", "bound").join(pairs, ["a", "cls"])
    if measure.box is not None:
        at = "x"
        if measure.box == "unit":
            visits = visits.withColumn("ux", _unit("x"))
            at = "ux"
        reachable = _box_distance(measure.box, dims, False, (at, at), ("blo", "bhi"))
        visits = visits.filter(F.expr(f"{reachable} <= bound"))
    visits = visits.groupBy("a", "cls", "b").agg(F.collect_list(F.struct("i", "x", "bound")).alias("visitors"))
    hosts = hosts.select(F.col("leaf").alias("b"), "grp", "ids", "xs", "roles")
    with arrow_rows(points.sparkSession, batch_rows):
        return stage(
            visits.join(hosts, "b")
            .select("visitors", "grp", "ids", "xs", "roles")
            .mapInArrow(
                blocks.across_leaves(_kernel(measure, dims), dims, k, skip_self),
                f"i bigint, grp bigint, nbrs {NEIGHBOURS}",
            ),
            "away",
        )


def search_in_rounds(
    home: DataFrame,
    pairs: DataFrame,
    hosts: DataFrame,
    measure: Measure,
    dims: int,
    k: int,
    skip_self: bool,
    batch_rows: int,
) -> DataFrame:
    """``i, grp, nbrs``: home lists completed by visits, the nearest leaves first.

    After the first round lists are cut to the k nearest and the bounds tightened, so that the
    second visits only leaves that are still within reach.  ``home`` is what ``search_home``
    returns; a point stays in the class it was paired under.
    """
    pairs = stage(pairs, "pairs")
    points = home.withColumn("cls", bound_class(F.col("bound")))
    first = search_away(
        points, pairs.filter(F.col("turn") <= FIRST_VISITS).drop("turn"), hosts, measure, dims, k, skip_self, batch_rows
    )
    rest = pairs.filter(F.col("turn") > FIRST_VISITS).drop("turn")
    if rest.isEmpty():
        return gathered(home, first, k)
    near = gathered(home, first, k).select("i", "grp", F.col("nbrs").alias("nearer"))
    reach = F.when(F.size("nearer") >= k, F.least("bound", k_distance(F.col("nearer"), k))).otherwise(F.col("bound"))
    points = stage(
        points.join(near, ["i", "grp"]).select("i", "leaf", "grp", "cls", "x", reach.alias("bound"), F.col("nearer").alias("nbrs")),
        "nearer",
    )
    second = search_away(points, rest, hosts, measure, dims, k, skip_self, batch_rows)
    return gathered(points, second, k)


def tile_bits(leaves: Leaves) -> int:
    """Leaves on a side of a tile, as a power of two.

    A group has at most sixteen tiles in a row, so that a leaf travels no more often when there are
    more leaves; only sides that would be too many bytes for a task are cut shorter.
    """
    room = TILE_BYTES // (leaves.leaf_rows * leaves.dims * 8)
    return max(TILE_BITS, min((leaves.most >> 4).bit_length(), room.bit_length() - 1))


def search_tiles(home: DataFrame, leaves: Leaves, k: int, skip_self: bool) -> DataFrame:
    """Neighbours of the points of ``home`` in all other leaves of their group within their bound.

    Where every leaf visits nearly every other, a copy of a point for each visit is most of the
    work.  Here the pairs of leaves of a group are a square, cut into tiles; a leaf travels whole,
    once for each tile of its row or column.  A tile is a bounded piece of work for one task, which
    holds the leaves that ask while those that offer pass by.
    """
    measure, dims = leaves.measure, leaves.dims
    bits = tile_bits(leaves)
    tile = lambda leaf: F.shiftright(leaf, bits)
    crowd = leaves.table.groupBy("grp").agg(F.count("*").alias("leaves")).filter("leaves > 1").select("grp")
    table = leaves.table.join(crowd, "grp", "left_semi")
    row = table.filter("queries > 0").select("grp", tile("leaf").alias("ta")).distinct()
    column = table.filter("candidates > 0").select("grp", tile("leaf").alias("tb")).distinct()
    asking = home.groupBy("leaf", "grp").agg(
        F.collect_list("i").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"), F.collect_list("bound").alias("bounds"),
    )
    either = ("grp", "ta", "tb", "asks", "leaf", "ids", "xs", "roles", "bounds", "lo", "hi")
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    a = asking.withColumn("ta", tile("leaf")).join(column, "grp").select(
        "*", F.lit(True).alias("asks"), none("int").alias("roles"), none("double").alias("lo"), none("double").alias("hi"),
    )
    b = table.filter("candidates > 0").withColumn("tb", tile("leaf")).join(row, "grp").select(
        "*", F.lit(False).alias("asks"), none("double").alias("bounds"),
    )
    cores = leaves.spark.sparkContext.defaultParallelism
    parts = max(4 * cores, int(leaves.spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(parts, max(cores, leaves.rows // leaves.leaf_rows))  # few bytes, much work: not to be joined by size
    dealt = a.select(*either).union(b.select(*either)).repartition(parts, "grp", "ta", "tb").sortWithinPartitions(
        "grp", "ta", "tb", F.desc("asks"), "leaf"
    )
    with arrow_rows(leaves.spark, max(1, leaves.batch_rows // 2)):
        return stage(
            dealt.mapInArrow(
                blocks.across_tiles(_kernel(measure, dims), measure.box, dims, k, skip_self),
                f"i bigint, grp bigint, nbrs {NEIGHBOURS}",
            ),
            "tiles",
        )


def with_roles(leaves: Leaves, roles: dict[int, int]) -> Leaves:
    """The same leaves, every point's role exchanged: one index serves several searches."""
    def now(role: Column) -> Column:
        new = F.lit(0)
        for old, given in roles.items():
            new = F.when(role == old, F.lit(given)).otherwise(new)
        return new

    bit = lambda of: F.size(F.filter("roles", lambda r: r.bitwiseAND(F.lit(of)) > 0))
    table = leaves.table.withColumn("roles", F.transform("roles", now))
    return replace(leaves, table=table.withColumn("queries", bit(QUERY)).withColumn("candidates", bit(CANDIDATE)))


def _search(leaves: Leaves, k: int | None, skip_self: bool) -> tuple[DataFrame, DataFrame | None]:
    """Neighbours found at home, and those found on visits to other leaves; with ``k``, all in
    the first."""
    with arrow_rows(leaves.spark, leaves.batch_rows):
        home = stage(search_home(leaves, k, skip_self, keep_x=leaves.split), "home")
    if not leaves.split:
        return home, None
    if k is not None and leaves.tiled:
        return gathered(home, search_tiles(home, leaves, k, skip_self), k), None
    asking = asking_boxes(home, leaves.measure, leaves.dims)
    pairs = leaf_pairs(asking, offering_boxes(leaves.table), leaves.levels, leaves.measure, leaves.dims, k)
    rest = (leaves.table, leaves.measure, leaves.dims, k, skip_self, leaves.batch_rows)
    if k is not None:
        return search_in_rounds(home, pairs, *rest), None
    return home, search_away(home.withColumn("cls", bound_class(F.col("bound"))), pairs, *rest)


def gathered(home: DataFrame, away: DataFrame | None, k: int | None = None) -> DataFrame:
    """``i, grp, nbrs`` from both searches, lists sorted by distance; with ``k``, cut at the
    k-th distance, ties kept, also on the way."""
    if away is None:
        return home.select("i", "grp", "nbrs")
    cut = (lambda c: c) if k is None else (lambda c: _cut(c, k)["nbrs"])
    some = away if k is None else away.select("i", "grp", cut(F.col("nbrs")).alias("nbrs"))
    more = some.groupBy("i", "grp").agg(F.flatten(F.collect_list("nbrs")).alias("more"))
    joined = home.select("i", "grp", "nbrs").join(more, ["i", "grp"], "left").select(
        "i",
        "grp",
        F.when(F.col("more").isNull(), F.col("nbrs"))
        .otherwise(F.sort_array(F.concat("nbrs", "more")))
        .alias("nbrs"),
    )
    return joined if k is None else joined.withColumn("nbrs", cut(F.col("nbrs")))


def k_distance(nbrs: Column, k: int) -> Column:
    """Distance of the k-th entry of a sorted neighbour list, of the last one if there
    are fewer, +inf if there is none."""
    place = F.least(F.size(nbrs), F.lit(k))
    return F.when(F.size(nbrs) == 0, F.lit(float("inf"))).otherwise(
        F.try_element_at(nbrs, F.greatest(place, F.lit(1)))["dist"]
    )


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once.  A filter that Spark moves below a projection
    repeats the projection's expressions, inside lambdas once for each element."""
    return F.transform(F.array(value), of)[0]


def _cut(nbrs: Column, k: int) -> Column:
    """Of a sorted neighbour list its k-distance ``kd``, and what is within that, ``nbrs``."""
    return _once(nbrs, lambda some: _once(
        k_distance(some, k),
        lambda kd: F.struct(kd.alias("kd"), F.filter(some, lambda e: e["dist"] <= kd).alias("nbrs")),
    ))


def keep_nearest(lists: DataFrame, k: int) -> DataFrame:
    """Cut sorted neighbour lists at their k-distance, ties kept; add ``kd`` and ``n``."""
    cut = lists.withColumn("cut", _cut(F.col("nbrs"), k))
    cut = cut.withColumns({"nbrs": F.col("cut.nbrs"), "kd": F.col("cut.kd")})
    return cut.withColumn("n", F.size("nbrs")).drop("cut")


def knn(
    points: DataFrame,
    k: int,
    measure: str | Measure = "euclidean",
    leaf_rows: int = LEAF_ROWS,
    stats_of: DataFrame | None = None,
    skip_self: bool = True,
) -> DataFrame:
    """k-distance neighbourhoods: ``i, grp, kd, n, nbrs[(dist, j)]``, ties at kd included.

    ``points`` has ``i`` and ``x``; ``role`` marks rows as query, candidate or both, and
    ``grp`` restricts neighbours to the same group.  Points should be distinct within a
    group (see ``sets.distinct_points``): copies are each other's neighbours at distance
    zero, and all of them tie.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    leaves = build_leaves(points, measure, leaf_rows, stats_of)
    return keep_nearest(gathered(*_search(leaves, k, skip_self)), k)


def knn_within(
    points: DataFrame, k: int, measure: str | Measure = "euclidean", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """The up to ``k`` nearest candidates (ties kept) within each query's own ``reach``:
    ``i, nbrs``, for the queries that have any."""
    return _some_within(build_leaves(points, measure, leaf_rows), k)


def _some_within(leaves: Leaves, k: int) -> DataFrame:
    found = gathered(*_search(leaves, k, True)).select("i", "nbrs")
    return found.filter(F.size("nbrs") > 0)


def knn_both_ways(
    stored: DataFrame, arriving: DataFrame, k: int, measure: str | Measure = "euclidean"
) -> tuple[DataFrame, DataFrame]:
    """(neighbourhoods ``i, nbrs`` of ``arriving(i, x)`` among all points, and for each of
    ``stored(i, x, reach)`` its up to ``k`` nearest arrivals within its reach, for those that
    have any), from one index."""
    infinite = F.lit(float("inf")).alias("reach")
    leaves = build_leaves(
        stored.select("i", "x", F.lit(STORED).alias("role"), "reach").unionByName(
            arriving.select("i", "x", F.lit(QUERY).alias("role"), infinite)
        ),
        measure,
    )
    asking = with_roles(leaves, {STORED: CANDIDATE, QUERY: QUERY | CANDIDATE})
    near = keep_nearest(gathered(*_search(asking, k, True)), k).select("i", "nbrs")
    return near, _some_within(with_roles(leaves, {STORED: QUERY, QUERY: CANDIDATE}), k)


def within_reach(
    points: DataFrame, measure: str | Measure = "euclidean", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """All candidates within each query's own ``reach``, one row ``i, j, dist`` each.

    Lists stay as short as a leaf; a query that reaches a crowd is never collected.
    """
    leaves = build_leaves(points, measure, leaf_rows)
    home, away = _search(leaves, None, True)
    return edges(home) if away is None else edges(home).unionByName(edges(away))


def edges(neighbourhoods: DataFrame) -> DataFrame:
    """One row ``i, j, dist`` per neighbour."""
    return neighbourhoods.select("i", F.explode("nbrs").alias("e")).select("i", "e.j", "e.dist")
