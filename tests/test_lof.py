import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.operators import lof as L
from farfield.operators import audit, sets
from farfield.operators.knn import knn
from farfield.session import stage
from tests import brute

RNG = np.random.default_rng(3)


def scores(df):
    return {r["i"]: (r["n"], r["kd"], r["lrd"], r["lof"]) for r in df.collect()}


def assert_close(got, want):
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose(got[i], want[i], rtol=1e-9)


@pytest.mark.parametrize("measure", ["euclidean", "manhattan"])
def test_equals_definition(points, measure):
    x = np.unique(RNG.integers(0, 20, size=(250, 2)).astype(float), axis=0)
    assert_close(scores(L.lof(points(x), 4, measure)), brute.lof(x, 4, measure))


def test_copies_share_the_score_of_their_vector(points):
    x = RNG.normal(size=(60, 2))
    doubled = np.concatenate([x, x[:20], x[:20]])
    got = scores(L.lof_with_points(points(doubled), 3))
    want = brute.lof(x, 3)
    assert len(got) == 100
    for i in range(100):
        np.testing.assert_allclose(got[i], want[i if i < 60 else (i - 60) % 20], rtol=1e-9)


def test_moving_all_points_changes_nothing(points):
    x = RNG.integers(0, 50, size=(80, 2)).astype(float)
    x = np.unique(x, axis=0)
    assert_close(scores(L.lof(points(x + 1024), 3)), scores(L.lof(points(x), 3)))


def test_single_point_has_no_factor(points):
    (n, kd, lrd, factor) = scores(L.lof(points([[1.0, 2.0]]), 3))[0]
    assert (n, kd, lrd) == (0, np.inf, np.inf) and np.isnan(factor)


def test_labels_and_inliers(points):
    x = np.concatenate([RNG.normal(size=(50, 2)), [[40, 40], [-40, 40]]])
    scored = stage(L.lof(points(x), 4), "scored")
    flagged = {r["i"] for r in L.label_top(scored, 2).filter("label = 1").collect()}
    assert flagged == {50, 51}
    order = [r["i"] for r in scored.orderBy("lof", "i").collect()]
    assert [r["i"] for r in L.top_inliers(scored, 10, 52).collect()] == order[:6]


def test_division_follows_floating_point(spark):
    row = spark.range(1).select(
        L.ratio(F.lit(0.0), F.lit(0.0)).alias("nan"),
        L.ratio(F.lit(2.0), F.lit(0.0)).alias("inf"),
        L.ratio(F.lit(1.0), F.lit(4.0)).alias("quarter"),
    ).first()
    assert np.isnan(row["nan"]) and row["inf"] == np.inf and row["quarter"] == 0.25


def test_audits_find_nothing_and_something(points):
    x = RNG.normal(size=(120, 2))
    near = stage(knn(points(x), 4), "near")
    assert all(r["violations"] == 0 for r in audit.profile_checks(near, 4).collect())
    broken = near.withColumn("kd", F.col("kd") / 2)
    assert any(r["violations"] > 0 for r in audit.profile_checks(broken, 4).collect())
    gone = points(x).filter("i < 10").select("i")
    assert any(r["violations"] > 0 for r in audit.deletion_checks(near, gone).collect())


def test_point_sets(spark, points):
    stored = points([[1, 1], [2, 2], [2, 2]]).withColumnRenamed("i", "seq")
    first = sets.first_arrivals(stored)
    assert sorted(r["seq"] for r in first.collect()) == [0, 1]
    more = points([[2, 2], [3, 3], [3, 3]]).select((F.col("i") + 10).alias("seq"), "x")
    assert sorted(r["seq"] for r in sets.add_points(first, more).collect()) == [0, 1, 11]
    assert [r["seq"] for r in sets.delete_points(first, more).collect()] == [0]
    inside = sets.box_search(points([[0, 0], [1, 2], [3, 3]]), [0, 0], [1, 2])
    assert sorted(r["i"] for r in inside.collect()) == [0, 1]
    boxes = spark.createDataFrame([(7, [0.5, 0.5], [3.0, 3.0])], "box int, lo array<double>, hi array<double>")
    found = sets.box_join(points([[0, 0], [1, 2], [3, 3], [3, 4]]), boxes, [1.0, 2.0])
    assert sorted(r["i"] for r in found.collect()) == [1, 2]
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.5), (4, 4.0)], "k int, v double")
    assert sorted(r["k"] for r in sets.unmatched_within(a, b, ["k"], "v", 1e-6).collect()) == [2, 3, 4]


def test_box_join_compares_without_a_loop_first(spark, points):
    boxes = spark.createDataFrame([(7, [0.0, 0.0, 1.0], [2.0, 3.0, 2.0])], "box int, lo array<double>, hi array<double>")
    found = sets.box_join(points([[0, 0, 1], [1, 2, 3], [2, 3, 2], [2, 4, 2]]), boxes, [1.0, 2.0])
    assert sorted(r["i"] for r in found.collect()) == [0, 2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"x#\d+\[0\] >= lo#\d+\[0\]", plan) and re.search(r"x#\d+\[1\] <= hi#\d+\[1\]", plan)
