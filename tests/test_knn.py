from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farfield.functions.measures import Measure, resolve
from farfield.operators import blocks, knn as knn_
from farfield.operators.knn import CANDIDATE, LEAF_ROWS, QUERY, knn, within_reach
from tests import brute

RNG = np.random.default_rng(7)


def lists(df):
    return {r["i"]: {e["j"]: e["dist"] for e in r["nbrs"]} for r in df.collect()}


@pytest.mark.parametrize(
    "x, k, measure, leaf_rows",
    [
        (RNG.normal(size=(700, 2)), 5, "euclidean", 32),
        (RNG.integers(0, 12, size=(600, 3)), 4, "manhattan", 16),  # many ties
        (RNG.normal(size=(300, 20)), 3, "cosine", 64),  # more coordinates than are unrolled
        (RNG.integers(0, 2, size=(300, 24)), 3, "euclidean", 64),  # the same, with ties
        (RNG.random(size=(150, 4)), 3, "intersection", 32),  # boxes say nothing
        (np.concatenate([RNG.normal(size=(300, 2)) * 1e-6, RNG.normal(size=(600, 2))]), 5, "euclidean", 16),
        (RNG.normal(size=(1500, 2)), 4, "euclidean", LEAF_ROWS),  # one leaf shared by tasks
        ([[1.0, 2.0]], 3, "euclidean", 16),
        ([[0.0], [1.0], [5.0]], 7, "euclidean", 2),  # fewer points than k
    ],
)
def test_equals_brute_force(points, x, k, measure, leaf_rows):
    x = np.unique(np.asarray(x, dtype=float), axis=0)
    assert lists(knn(points(x), k, measure, leaf_rows)) == brute.neighbours(x, k, measure)


@pytest.mark.parametrize("leaves", [100, 700, 4000])
def test_a_leaf_travels_no_more_often_with_more_leaves(leaves):
    some = knn_.Leaves(None, resolve("euclidean"), 64, LEAF_ROWS, leaves * LEAF_ROWS, LEAF_ROWS, 2, True, leaves)
    assert leaves >> knn_.tile_bits(some) < 16
    assert LEAF_ROWS * 64 * 8 << knn_.tile_bits(some) <= knn_.TILE_BYTES


@pytest.mark.parametrize("name", ["euclidean", "cosine"])
def test_screens_lose_no_neighbour(name):
    """Ties, copies, vectors of zeros, of tiny and of huge numbers; few pairs a row and many."""
    measure = resolve(name)
    x = np.concatenate([
        RNG.integers(0, 2, size=(90, 20)), RNG.normal(size=(90, 20)), RNG.normal(size=(20, 20)) * 1e-100,
        RNG.normal(size=(20, 20)) * 1e120, np.zeros((2, 20)), np.full((1, 20), np.nan),
    ]).astype(float)
    with np.errstate(all="ignore"):
        dist = measure.block(x, x)
        dist[np.isnan(dist) | np.eye(len(x), dtype=bool)] = np.inf
        if name == "cosine":  # norms whose product is zero have no angle
            square = (x * x).sum(axis=1)
            dist[square[:, None] * square == 0] = np.inf
        for limit in (np.full(len(x), np.inf), np.sort(dist, axis=1)[:, 5]):
            ids = np.arange(len(x))
            row, j, found, _ = blocks.nearest(blocks.screened(measure), x, x, ids, ids, 3, limit, True)
            want = (dist <= np.minimum(np.sort(dist, axis=1)[:, 2], limit)[:, None]) & (dist < np.inf)
            assert set(zip(row, j)) == set(zip(*np.nonzero(want)))
            assert all(dist[a, b] == d for a, b, d in zip(row, j, found))


def test_screen_compares_once_where_limits_are_tight(monkeypatch):
    """Rows that pass few pairs are neither sorted nor partitioned."""
    x = RNG.normal(size=(300, 20))
    limit = np.sort(resolve("euclidean").block(x, x), axis=1)[:, 4]
    near, want = blocks.screened(resolve("euclidean")), np.argsort(resolve("euclidean").block(x, x), axis=1)[:, 1:5]
    monkeypatch.setattr(np, "partition", None)
    row, j, *_ = blocks.nearest(near, x, x, np.arange(300), np.arange(300), 4, limit, True)
    assert (j.reshape(300, 4) == want).all()


OWN = np.random.default_rng(17)


@pytest.mark.parametrize("name", ["euclidean", "cosine"])
def test_a_block_is_prepared_once_and_survivors_computed_together(name):
    calls, measure = [], resolve(name)
    counted = replace(
        measure,
        screen=lambda *blocks_: calls.append("screen") or measure.screen(*blocks_),
        rows=lambda *pairs: calls.append("rows") or measure.rows(*pairs),
    )
    x, ids = OWN.normal(size=(1500, 20)), np.arange(1500)
    dist = measure.block(x, x)
    limit = np.sort(dist, axis=1)[:, 2]
    row, j, found, _ = blocks.nearest(blocks.screened(counted), x, x, ids, ids + 1500, 2, limit, True)
    assert calls.count("screen") == 1 and calls.count("rows") <= 2
    assert all(dist[a, b - 1500] == d for a, b, d in zip(row, j, found)) and len(row) == 3000


def test_single_precision_rules_out_nothing_near():
    """Angles that single precision cannot tell apart."""
    x = np.zeros((400, 32))
    x[:, 0], x[:, 1] = 1.0, OWN.permutation(400) * 1e-6
    ids, dist = np.arange(400), resolve("cosine").block(x, x)
    np.fill_diagonal(dist, np.inf)
    for limit in (np.full(400, np.inf), np.sort(dist, axis=1)[:, 3]):
        row, j, found, _ = blocks.nearest(blocks.screened(resolve("cosine")), x, x, ids, ids, 3, limit, True)
        want = dist <= np.minimum(np.sort(dist, axis=1)[:, 2], limit)[:, None]
        assert set(zip(row, j)) == set(zip(*np.nonzero(want)))
        assert all(dist[a, b] == d for a, b, d in zip(row, j, found))


def test_a_leaf_comes_to_a_task_once_a_tile(points, monkeypatch):
    """Not once for each leaf that it meets."""
    def counting(*_):
        def run(batches):
            yield pa.RecordBatch.from_pylist(
                [{"i": sum(b.num_rows for b in batches), "grp": 0, "nbrs": []}],
                pa.schema([("i", pa.int64()), ("grp", pa.int64()), ("nbrs", pa.list_(blocks.NEIGHBOUR))]),
            )
        return run

    x = OWN.normal(size=(320, 20))
    leaves = knn_.build_leaves(points(x), leaf_rows=8)
    assert leaves.most >= 40
    home = knn_.search_home(leaves, 3, True, True)
    monkeypatch.setattr(blocks, "across_tiles", counting)
    read = sum(r["i"] for r in knn_.search_tiles(home, leaves, 3, True).collect())
    assert read <= 2 * 16 * leaves.most < leaves.most * (leaves.most - 1)  # the pairs of leaves


@pytest.mark.parametrize("name", ["euclidean", "cosine", "intersection"])
def test_tiles_with_groups_roles_and_ties(points, name):
    """Leaves of queries only and of candidates only, copies, and a far group."""
    x = np.concatenate([OWN.integers(1, 4, size=(200, 20)), OWN.normal(size=(200, 20)) + 2]).astype(float)
    group, asks, offers = np.arange(400) % 3, np.arange(400) % 5 > 0, np.arange(400) % 7 > 0
    x[group == 2] *= 50
    x[30:60] = x[:30]
    code = F.array(*(F.lit(int(g)) for g in group))
    role = F.array(*(F.lit(int(a) * QUERY + int(o) * CANDIDATE) for a, o in zip(asks, offers)))
    at = F.col("i").cast("int")
    rows = points(x).withColumns({"grp": code[at], "role": role[at]}).filter("role > 0")
    allowed = (group[:, None] == group) & asks[:, None] & offers
    want = {i: n for i, n in brute.neighbours(x, 4, name, allowed).items() if asks[i]}
    assert lists(knn(rows, 4, name, leaf_rows=8)) == want


def test_three_tied_at_the_k_distance(points):
    x = [[0, 0], [1, 0], [0, 2], [2, 0], [0, -2], [9, 9]]
    near = knn(points(x), 2).filter("i = 0").first()
    assert (near["n"], near["kd"]) == (4, 2.0)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "i bigint, x array<double>")
    assert knn(empty, 3).count() == 0


def test_queries_and_candidates_apart(spark, points):
    x = RNG.normal(size=(500, 2))
    x[:40] += 30  # queries far from every candidate: no leaf of theirs holds any
    rows = points(x).withColumn("role", F.when(F.col("i") < 100, QUERY).otherwise(CANDIDATE))
    allowed = np.zeros((500, 500), bool)
    allowed[:100, 100:] = True
    want = {i: n for i, n in brute.neighbours(x, 4, allowed=allowed).items() if i < 100}
    assert lists(knn(rows, 4, leaf_rows=16)) == want


def test_groups_with_one_hot_group(points):
    x = RNG.normal(size=(600, 2))
    group = np.where(np.arange(600) < 250, 0, RNG.integers(1, 80, size=600))
    code = F.array(*(F.lit(int(g)) for g in group))
    rows = points(x).withColumn("grp", code[F.col("i").cast("int")])
    allowed = group[:, None] == group[None, :]
    assert lists(knn(rows, 3, leaf_rows=16)) == brute.neighbours(x, 3, allowed=allowed)


def test_own_reach(points):
    x = RNG.normal(size=(400, 2))
    reach = np.where(np.arange(400) % 2, 0.1, 0.3)
    rows = points(x).withColumn("reach", F.when(F.col("i") % 2 == 1, 0.1).otherwise(0.3))
    got = {(r["i"], r["j"]) for r in within_reach(rows, leaf_rows=32).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, j) for i, j in zip(*np.nonzero(dist <= reach[:, None])) if i != j}
    assert got == {(int(i), int(j)) for i, j in want}


def test_own_measure(points):
    x = RNG.normal(size=(60, 2))
    largest = Measure("largest", None, lambda a, b: np.abs(a - b).max(axis=-1))
    want = brute.neighbours(x, 3, largest)
    assert lists(knn(points(x), 3, largest, leaf_rows=16)) == want


def test_unknown_measure(points):
    with pytest.raises(ValueError, match="unknown distance"):
        knn(points([[1.0]]), 1, "chebyshev")


def test_no_cross_product_in_the_plan(points):
    x = RNG.normal(size=(600, 2))
    plan = knn(points(x), 3, leaf_rows=16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=40, unique=True))
def test_any_small_grid(points, cells):
    assert lists(knn(points(cells), 3, leaf_rows=4)) == brute.neighbours(cells, 3)


def test_wide_leaves_meet_in_tiles(points):
    x = RNG.normal(size=(600, 20))
    leaves = knn_.build_leaves(points(x), "cosine", 16)
    home = knn_.search_home(leaves, 3, True, True)
    away = knn_.search_tiles(home, leaves, 3, True)
    tiles = leaves.table.select(F.shiftright("leaf", 3)).distinct().count()
    assert leaves.table.count() > 2 * tiles
    # a list for each tile, not for each leaf
    assert away.groupBy("i").count().agg(F.max("count")).first()[0] <= tiles
    assert away.agg(F.max(F.size("nbrs"))).first()[0] == 3


def test_lists_are_cut_without_repeating_their_making(points):
    lists = knn_.gathered(*(points([[0.0]]).selectExpr(
        "i", "0L grp", "array(struct(1D dist, 2L j)) nbrs") for _ in range(2)), 3)
    plan = knn_.edges(knn_.keep_nearest(lists, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") + plan.count("array_sort") <= 3
