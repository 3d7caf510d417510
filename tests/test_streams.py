import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.functions import hashing as H
from farfield.operators import lof as L
from farfield.operators.lsh import neighbours
from farfield.streaming import areas as A
from farfield.streaming import buckets, ilof, links
from farfield.streaming.detect import detector
from farfield.streaming.rlof import WindowedLof
from farfield.streaming.sources import file_stream, parsed, replay
from tests.brute_window import Window

RNG = np.random.default_rng(5)


def records(spark, x):
    rows = [(f"k{i}", " ".join(map(str, p)) + " ", i) for i, p in enumerate(np.asarray(x, float).tolist())]
    return spark.createDataFrame(rows, "key string, value string, seq bigint")


def scores(df):
    return {r["i"]: (r["n"], r["kd"], r["lrd"], r["lof"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose(got[i], want[i], rtol=1e-9)


def test_incremental_equals_batch_with_ties_and_copies(spark, tmp_path):
    x = RNG.integers(0, 7, size=(150, 3))
    stream = file_stream(spark, replay(records(spark, x), 3, str(tmp_path / "replay")))
    model = ilof.IncrementalLof(spark, str(tmp_path / "state"), 4)
    query = model.start(parsed(stream, 3), str(tmp_path / "ckpt"), str(tmp_path / "sink"), 5, 150)
    query.awaitTermination()
    points = parsed(records(spark, x), 3).select(F.col("seq").alias("i"), "x")
    same(scores(model.scores()), scores(L.lof(points, 4)))
    labels = spark.read.parquet(str(tmp_path / "sink"))
    assert labels.count() == 150 and labels.filter("label = 1").count() >= 5
    assert {r["reason"] for r in labels.select("reason").distinct().collect()} == {"final"}


def test_incremental_compacts_and_replays_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ilof, "COMPACT_AFTER", 2)
    x = RNG.normal(size=(260, 2))
    x[200:230] = x[:30]  # a batch with copies of stored points
    points = parsed(records(spark, x), 2)
    model = ilof.IncrementalLof(spark, str(tmp_path), 4)
    for b, (low, high) in enumerate([(0, 150), (150, 200), (200, 230), (230, 260)]):
        batch = points.filter(F.col("seq").between(low, high - 1))
        model.apply(batch, b)
        if b == 1:
            model.apply(batch, b)  # run again after a failure
    same(scores(model.scores()), scores(L.lof(points.select(F.col("seq").alias("i"), "x"), 4)))
    assert len(model.versions.manifest(3)["segments"]) <= 2
    assert model.labels(5).count() == 260


def test_a_batch_of_copies_only(spark, tmp_path):
    x = np.tile(RNG.normal(size=(20, 2)), (2, 1))
    points = parsed(records(spark, x), 2)
    model = ilof.IncrementalLof(spark, str(tmp_path), 3)
    model.apply(points.filter("seq < 20"), 0)
    before = scores(model.scores())
    model.apply(points.filter("seq >= 20"), 1)
    same(scores(model.scores()), before)
    assert model.labels(1).filter("label = 1").count() == 2


@pytest.mark.parametrize("measure", ["euclidean", "cosine"])
def test_a_batch_reads_the_leaves_it_can_touch(spark, tmp_path, monkeypatch, measure):
    """Small leaves, one to a folder: what is read follows the batch, and results stay exact."""
    monkeypatch.setattr(links, "FOLDER_BITS", 0)
    monkeypatch.setattr(ilof, "COMPACT_AFTER", 3)
    x = RNG.uniform(1, 40, size=(360, 2)).round(1)
    x[300:310] = RNG.uniform(1, 2, size=(10, 2)).round(2)  # a batch in one corner
    x[310:320] = np.concatenate([x[:5], x[300:305]])  # copies of stored points
    points = parsed(records(spark, x), 2)
    model = ilof.IncrementalLof(spark, str(tmp_path), 4, measure, leaf_rows=16)
    seen = []
    for b, (low, high) in enumerate([(0, 300), (300, 310), (310, 320), (320, 360)]):
        model.apply(points.filter(F.col("seq").between(low, high - 1)), b)
        seen.append(model.versions.manifest(b)["read"])
    same(scores(model.scores()), scores(L.lof(points.select(F.col("seq").alias("i"), "x"), 4, measure)))
    assert seen[0] == 0 and seen[2] == 0  # copies change nothing
    if measure == "euclidean":
        assert 0 < seen[1] < 150


def test_links_say_who_lists_whom(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ilof, "COMPACT_AFTER", 2)  # the last batch merges the newer segments
    x = RNG.uniform(0, 9, size=(240, 2))
    points = parsed(records(spark, x), 2)
    model = ilof.IncrementalLof(spark, str(tmp_path), 3, leaf_rows=8)
    for b, (low, high) in enumerate([(0, 200), (200, 210), (210, 240)]):
        model.apply(points.filter(F.col("seq").between(low, high - 1)), b)
        segments = model.versions.manifest(b)["segments"]
        rows = links.rows_of(model.versions, segments).collect()
        at = {r["i"]: r["leaf"] for r in rows}
        told = model.versions.read([s["links"] for s in segments], links.LINKS).collect()
        true = {(at[e["j"]], r["leaf"]) for r in rows for e in r["nbrs"] if at[e["j"]] != r["leaf"]}
        assert true <= {(r["of"], r["by"]) for r in told}
        bound = {}
        for r in model.versions.read([s["reach"] for s in segments], links.BOXES).collect():
            bound[r["leaf"]] = max(r["bound"], bound.get(r["leaf"], 0.0))
        assert all(r["kd"] <= bound[r["leaf"]] for r in rows)


RULES = dict(k=3, window=16, inlier_percent=10, max_age=4, dims=2, top=3, step=10)


def drifting():
    """Thirty points that, in groups of ten, meet every rule."""
    x = np.round(np.random.default_rng(2).normal(size=(30, 2)), 3)
    x[16:22] = np.round(x[:6] + 0.01, 3)  # arrivals near old points, so inside areas
    x[23] = x[22]  # and a copy
    return x


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_windowed_follows_the_rules_whatever_the_batches(spark, tmp_path, batches):
    x = drifting()
    model = WindowedLof(spark, f"{tmp_path}/state", **RULES, trace=f"{tmp_path}/trace")
    points = parsed(records(spark, x), 2)
    for b, part in enumerate(np.array_split(np.arange(len(x)), batches)):
        batch = points.filter(F.col("seq").between(int(part[0]), int(part[-1])))
        model.apply(batch, b)
        if b == 2:
            model.apply(batch, b)  # run again after a failure
    labels = {int(r["key"][1:]): (r["label"], r["reason"]) for r in model.labels().collect()}
    history, want = Window(**RULES).run(x.tolist())
    assert labels == want
    assert {reason for _, reason in want.values()} == {"absorbed", "summarized", "aged", "final"}
    windows, areas = (spark.read.parquet(f"{tmp_path}/trace/{n}").collect() for n in ("window", "areas"))
    assert {r["step"] for r in windows} == set(range(1, len(history) + 1))
    for s, (held, centers) in enumerate(history, 1):
        got = {r["i"]: r for r in windows if r["step"] == s}
        assert got.keys() == held.keys() and len(got) <= RULES["window"], s
        for i, p in held.items():
            assert ({e["j"] for e in got[i]["nbrs"]}, got[i]["ts"]) == p[:2], (s, i)
            np.testing.assert_allclose([got[i][c] for c in ("kd", "lrd", "lof")], p[2:], rtol=1e-9)
        got = {r["center"]: r for r in areas if r["step"] == s}
        assert got.keys() == centers.keys(), s
        for c, a in centers.items():
            assert (got[c]["number"], got[c]["ts"]) == a[:2], (s, c)
            np.testing.assert_allclose([got[c][n] for n in ("radius", "avg_kd", "avg_lrd")], a[2:], rtol=1e-9)
    # what batches before the last two left is gone
    state = tmp_path / "state"
    assert {p.name for p in (state / "commits").glob("[0-9]*.json")} == {f"{b}.json" for b in range(max(0, batches - 2), batches)}
    assert all(len(list((state / n).glob("v*"))) == min(2, batches) for n in ("window", "areas", "keys", "waiting", "top"))


def test_windowed_sink_holds_every_label(spark, tmp_path):
    source = str(tmp_path / "in")
    for b in range(2):
        rows = records(spark, drifting()).filter(F.col("seq").between(15 * b, 15 * b + 14))
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, value string, seq bigint").option("maxFilesPerTrigger", 1).parquet(source)
    want = {f"k{i}": r for i, r in Window(**RULES).run(drifting().tolist())[1].items()}
    for name, total in (("a", 30), ("b", None)):
        model = WindowedLof(spark, str(tmp_path / name), **RULES)
        sink = str(tmp_path / f"{name}-sink")
        model.start(parsed(stream, 2), str(tmp_path / f"{name}-ckpt"), sink, total).awaitTermination()
        if total is None:
            model.finish(sink)
            model.finish(sink)
        held = spark.read.parquet(sink).collect()
        assert len(held) == 30 and {r["key"]: (r["label"], r["reason"]) for r in held} == want


def test_arrivals_may_be_found_in_buckets(spark, tmp_path):
    x = RNG.normal(size=(60, 2))
    points = parsed(records(spark, x), 2)
    # no planes to tell points apart: one bucket, so the result is exact
    family = H.sign_family(np.zeros((1, 2, 2)))
    model = detector("ILOF", spark, str(tmp_path), k=3, technique="planes", hashed=family)
    model.apply(points.filter("seq < 40"), 0)
    model.apply(points.filter("seq >= 40"), 1)
    same(scores(model.scores()), scores(L.lof(points.select(F.col("seq").alias("i"), "x"), 3)))


def neighbour_lists(rows):
    return {r["i"]: [(e["j"], round(e["dist"], 9)) for e in r["nbrs"]] for r in rows.collect()}


def plain_stream(spark, x, cuts, k, technique, family):
    """Lists after each batch by definition: arrivals search by technique among all points so far,
    lists that they enter grow by them."""
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lists = {}
    for low, high in zip([0, *cuts], cuts):
        points = parsed(records(spark, x[:high]), x.shape[1]).select(F.col("seq").alias("i"), "x")
        known = neighbour_lists(neighbours(points, k, technique, hashed=family))
        for i, has in lists.items():
            reach = has[-1][1] if len(has) >= k else np.inf
            pool = sorted([(d, j) for j, d in has] + [
                (round(dist[i, j], 9), j) for j in range(low, high) if round(dist[i, j], 9) <= reach])
            lists[i] = [(j, d) for d, j in pool if d <= pool[min(k, len(pool)) - 1][0]]
        lists |= {i: known[i] for i in range(low, high)}
    return lists


@pytest.mark.parametrize("technique", ["kd", "tables", "planes"])
def test_techniques_in_a_stream(spark, tmp_path, monkeypatch, technique):
    monkeypatch.setattr(ilof, "COMPACT_AFTER", 2)
    monkeypatch.setattr(buckets, "FOLDER_ROWS", 16)  # many folders
    x = np.unique(np.random.default_rng(8).normal(size=(150, 3)).round(3), axis=0)
    np.random.default_rng(9).shuffle(x)
    # twelve sides leave points alone; wide steps put many into one bucket
    family = {
        "kd": None,
        "tables": H.projection_family(H.gaussian_planes(3, 2, 3, 4), [[17, 71], [42, 5], [3, 9]], 1.5),
        "planes": H.sign_family(H.gaussian_planes(3, 12, 2, 5)),
    }[technique]
    model = ilof.IncrementalLof(spark, str(tmp_path), 4, technique=technique, hashed=family)
    points, cuts = parsed(records(spark, x), 3), [60, 100, 130, len(x)]
    for b, (low, high) in enumerate(zip([0, *cuts], cuts)):
        model.apply(points.filter(F.col("seq").between(low, high - 1)), b)
        if b == 2:
            model.apply(points.filter(F.col("seq").between(low, high - 1)), b)  # again after a failure
    model.apply(points.filter("seq < 5").withColumn("seq", F.col("seq") + 1000), len(cuts))  # copies only
    assert neighbour_lists(model.scores()) == plain_stream(spark, x, cuts, 4, technique, family)
    segments = model.versions.manifest(len(cuts))["segments"]
    assert len(segments) <= 2
    if family:
        kept = buckets.stored(model.versions, segments)
        assert kept.count() == len(x) * family.tables == kept.select("i", "tab").distinct().count()


def test_arrivals_read_only_folders_of_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FOLDER_ROWS", 8)
    x = RNG.normal(size=(400, 2))
    family = H.projection_family(H.gaussian_planes(2, 2, 1, 4), [[0, 0]], 0.5)
    model = ilof.IncrementalLof(spark, str(tmp_path), 3, technique="tables", hashed=family)
    model.apply(parsed(records(spark, x), 2), 0)
    own = model.versions.manifest(0)["segments"]
    every = buckets.stored(model.versions, own)
    first = every.orderBy("grp").first()
    asked = spark.createDataFrame([(first["grp"],)], "grp bigint")
    found = buckets.members(model.versions, own, asked)
    want = every.join(asked, "grp", "left_semi").count()
    others = [f for f in (tmp_path / "buckets" / "v0").glob("part=*/*.parquet") if f.parent.name != f"part={first['part']}"]
    assert len(others) > 5
    for f in others:
        f.write_bytes(b"no table")  # reading one of these would fail
    assert found.count() == want > 0


def test_records_of_a_file_are_shared_among_tasks(spark, tmp_path):
    """Parsing and finding first arrivals of a large file are no single task's work."""
    path, tasks = replay(records(spark, RNG.normal(size=(400, 2))), 1, str(tmp_path / "replay")), []
    stream = parsed(file_stream(spark, path), 2).writeStream.foreachBatch(
        lambda rows, _: tasks.extend(rows.groupBy(F.spark_partition_id()).count().collect())
    )
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(tasks) == spark.sparkContext.defaultParallelism and sum(t["count"] for t in tasks) == 400


def test_replay_is_read_in_order(spark, tmp_path):
    path, seen = replay(records(spark, RNG.normal(size=(57, 2))), 8, str(tmp_path / "replay")), []
    stream = file_stream(spark, path).writeStream.foreachBatch(
        lambda batch, _: seen.append(sorted(r["seq"] for r in batch.collect()))
    )
    stream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert [b[0] for b in seen] == list(range(0, 57, 8)) and sum(seen, []) == list(range(57))
    assert replay(records(spark, np.zeros((0, 2))), 3, str(tmp_path / "none"))


def test_unknown_choices(spark, points, tmp_path):
    with pytest.raises(ValueError, match="unknown algorithm"):
        detector("milof", spark, str(tmp_path), k=3)
    with pytest.raises(ValueError, match="unknown technique"):
        detector("ilof", spark, str(tmp_path), k=3, technique="hnsw")
    with pytest.raises(ValueError, match="needs a hash family"):
        detector("ilof", spark, str(tmp_path), k=3, technique="tables")
    with pytest.raises(ValueError, match="unknown technique"):
        L.lof(points([[1.0]]), 1, technique="hnsw")
    with pytest.raises(ValueError, match="needs a hash family"):
        L.lof(points([[1.0]]), 1, technique="planes")


def test_point_on_the_rim_and_inside_two_areas(spark, points):
    areas = spark.createDataFrame(
        [(0, [0.0, 0.0], 1.0), (1, [1.0, 0.0], 2.0)], "center bigint, x array<double>, radius double"
    )
    arriving = points([[9, 9], [1, 0]]).withColumn("i", F.col("i") + 10)
    found = {(r["center"], r["i"], r["dist"]) for r in A.members(areas, arriving, "euclidean").collect()}
    assert found == {(0, 11, 1.0), (1, 11, 0.0)}


def test_virtual_points_stand_on_the_rim(spark):
    area = spark.createDataFrame([(4, [1.0, 2.0], 0.5)], "center bigint, x array<double>, radius double")
    got = {(r["axis"], r["side"]): (r["j"], tuple(r["x"])) for r in A.virtual_points(area, 2).collect()}
    assert got == {
        (0, 0): (-17, (1.5, 2.0)), (0, 1): (-18, (0.5, 2.0)),
        (1, 0): (-19, (1.0, 2.5)), (1, 1): (-20, (1.0, 1.5)),
    }
    back = spark.createDataFrame([(-17,), (-20,)], "j bigint").select(A.center_of(F.col("j"), 2)).collect()
    assert [r[0] for r in back] == [4, 4]


def test_virtual_points_need_a_rim_distance():
    with pytest.raises(ValueError, match="euclidean and manhattan"):
        from farfield.functions.measures import virtual_distance

        virtual_distance(F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(0), "cosine")
