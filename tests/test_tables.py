"""Buckets of several runs searched in one pass, and what that leaves on disk."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farfield.functions import hashing as H
from farfield.functions import measures as M
from farfield.operators import blocks, lsh
from farfield.operators.knn import knn
from farfield.session import scratch_dir
from tests import brute

RNG = np.random.default_rng(23)
RUNS, TABLES = 3, (1, 2, 4)


def plain(x, signs, measure, k):
    """Lists and pairs of every run and number of tables, from all pairs of points."""
    with np.errstate(all="ignore"):
        dist = measure.block(x, x)
    lists, pairs = {}, {}
    for run in range(RUNS):
        for t in TABLES:
            share = (signs[:, None, :t, run] == signs[None, :, :t, run]).any(axis=2)
            pairs[run, t] = share.sum()
            for i, row in enumerate(share):
                near = sorted((dist[i, j], j) for j in np.flatnonzero(row) if not np.isnan(dist[i, j]))[:k]
                if near:
                    lists[i, run, t] = near
    return lists, pairs


def made(dims, n=300):
    """Points with copies and a zero, and buckets of one run that hold most, of one some, of one few."""
    x = RNG.normal(size=(n, dims))
    x[n - 20 :] = x[:20]
    x[5] = 0
    signs = np.stack([RNG.integers(0, most, size=(n, TABLES[-1])) for most in (2, 25, 150)], axis=2)
    signs[n - 20 :] = signs[:20]
    return x, signs.astype(np.int64)


@pytest.mark.parametrize("dense", [1, 16, 10**9])
@pytest.mark.parametrize("dims", [3, 20])
@pytest.mark.parametrize("name", ["euclidean", "manhattan", "cosine", "intersection"])
def test_all_runs_and_tables(name, dims, dense, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE", dense)  # by lists, by either, by comparing all
    monkeypatch.setattr(blocks, "FIRST_BLOCK", 8)
    (x, signs), k, measure = made(dims), 3, M.resolve(name)
    n, half = len(x), len(x) // 2
    parts = [np.arange(half), np.arange(half, n)]
    tiles = [(a, b, asks, i) for a in (0, 1) for b in (0, 1) for asks in (True, False) for i in parts[a if asks else b]]
    ta, tb, asks, i = (np.array(c) for c in zip(*tiles))
    flat = lambda v: blocks.lists(pa.array(v[i].ravel()), np.full(len(i), v[0].size))
    table = pa.table({
        "ta": pa.array(ta, pa.int32()), "tb": pa.array(tb, pa.int32()), "asks": asks, "i": i, "x": flat(x), "signs": flat(signs),
    })
    run = blocks.across_tables(measure, 16, k, TABLES, 64)
    out = [r for b in run(iter(table.to_batches(max_chunksize=70))) for r in b.to_pylist()]
    lists, pairs = {}, {}
    for r in out:
        if r["i"] is not None and r["step"] < 0:
            for s, t in enumerate(TABLES):
                lists.setdefault((r["i"], r["run"], t), []).extend((e["dist"], e["j"]) for e in r["nbrs"] if e["step"] <= s)
        else:
            at = r["run"], TABLES[r["step"]]
            pairs[at] = pairs.get(at, 0) + r["pairs"]
    lists = {at: sorted(near)[:k] for at, near in lists.items() if near}
    want, counted = plain(x, signs, measure, k)
    assert pairs == counted
    assert lists.keys() == want.keys()
    for at, near in want.items():
        assert [j for _, j in lists[at]] == [j for _, j in near], at


def test_manhattan_is_screened_within_its_error(points):
    for scale in (1e-9, 1.0, 1e12):
        x = RNG.normal(size=(200, 24)) * scale
        x[3] = x[4]
        got = {r["i"]: {e["j"]: e["dist"] for e in r["nbrs"]} for r in knn(points(x), 4, "manhattan", 64).collect()}
        assert got == brute.neighbours(x, 4, M.resolve("manhattan"))
    flat = np.ones((5, 20))
    about, top, _ = M.resolve("manhattan").screen(flat, flat, np.zeros(5))
    assert (about(slice(0, 5)) <= top[:, None]).all()


def staged(spark):
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/farfield")
    files = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in files.listStatus(jvm)} if files.exists(jvm) else set()


def test_grid_writes_a_vector_once_and_leaves_nothing(points, spark, monkeypatch):
    """A copy of a vector for each bucket of each run filled the disk."""
    df, rows, plain_stage = points(RNG.normal(size=(120, 20))), {}, lsh.stage

    def counted(frame, name):
        out = plain_stage(frame, name)
        if "x" in out.columns or "xs" in out.columns:
            rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lsh, "stage", counted)
    before = staged(spark)
    grid = lsh.quality_grid(df, 3, 20, {"l2": 4.0, "l1": 12.0}, (1, 2), (1, 2, 4), seed=3).collect()
    assert rows and max(rows.values()) <= 120  # not for each of 2 runs and 4 tables
    assert staged(spark) == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert len(grid) == 18
    for r in grid:
        times = 8 if r["family"] == "cos" else 1
        assert r["hashes"] in (times, 2 * times) and r["queries"] == 120 and r["tp"] + r["fn"] == 360
    one = H.family("l1", 20, 2, 4, 1.2, 3)
    share = df.select("i", one.buckets(F.col("x")).alias("b")).toPandas()["b"].apply(tuple)
    touched = sum(any(p == q for p, q in zip(a[:2], b[:2])) for a in share for b in share)
    assert [r["touched_pct"] for r in grid if (r["family"], r["hashes"], r["tables"]) == ("l1", 2, 2)] == [
        pytest.approx(touched * 100 / 120**2)
    ]


def test_sides_are_signed_as_the_column_signs_them(points):
    """Taking a thousand sides of a vector one by one in a plan took longer than the search."""
    x = RNG.normal(size=(1100, 5))
    x[3], x[4, 2], x[5] = 0, np.nan, x[6]
    for sides in (6, 64):
        family = H.sign_family(H.uniform_planes(5, sides, 3, 8), "cosine")
        told = [np.stack(lsh.signed_rows(points(x), f, (2, 5, sides)).orderBy("i").toPandas()["signs"]) for f in (
            family, replace(family, sides_of=None),
        )]
        assert told[0].shape == told[1].shape == (1100, 9)
        for a, b in zip(*(t.T for t in told)):
            pairs = set(zip(a.tolist(), b.tolist()))
            assert len(pairs) == len(set(a.tolist())) == len(set(b.tolist()))
