from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.functions import hashing as H
from farfield.functions import measures as M
from farfield.operators import evaluate, hamming, lsh, synth
from farfield.operators.knn import knn
from tests import brute

RNG = np.random.default_rng(11)


def shared_buckets(df, family):
    rows = df.select("i", *(family.bucket(F.col("x"), t).alias(f"t{t}") for t in range(family.tables)))
    rows = rows.orderBy("i").toPandas()
    share = np.zeros((len(rows), len(rows)), bool)
    for t in range(family.tables):
        key = rows[f"t{t}"].values
        share |= key[:, None] == key[None, :]
    return share


def lists(df):
    return {r["i"]: {e["j"]: e["dist"] for e in r["nbrs"]} for r in df.collect()}


@pytest.mark.parametrize(
    "family",
    [
        H.sign_family(H.uniform_planes(4, 3, 3, 1)),
        H.cosine_family(4, 5, 2, 2),
        H.l2_family(4, 2, 2, 3, 3),
        H.l1_family(4, 1, 2, 3, 4),
        H.sign_family(H.gaussian_planes(4, 64, 1, 5), "cosine"),
    ],
    ids=lambda f: f.name,
)
def test_neighbours_among_shared_buckets(points, family):
    x = RNG.normal(size=(250, 4))
    df = points(x)
    share = shared_buckets(df, family)
    assert lists(lsh.lsh_knn(df, 4, family)) == brute.neighbours(x, 4, family.measure, share)
    assert lsh.touched_pairs(df, family) == share.sum()


def test_touched_pairs_in_chunks_and_with_copies(points):
    x = RNG.integers(0, 6, size=(300, 4)).astype(float)
    df, family = points(x), H.sign_family(H.uniform_planes(4, 2, 16, 1) - 0.1)
    assert lsh.touched_pairs(df, family, chunk=8) == shared_buckets(df, family).sum()
    signed = df.select(family.buckets(F.col("x")).alias("signs"))
    per_table = {r["tab"]: int(r["pairs"]) for r in lsh.shared_pairs(signed, 8).collect()}
    few = H.Family(family.name, family.measure, 3, family.signature, family.bits)
    assert sum(n for t, n in per_table.items() if t < 3) == shared_buckets(df, few).sum()


def test_recall_grows_with_tables_and_seeds_are_stable(points):
    df = points(RNG.normal(size=(200, 6)))
    exact = lsh.first_k(knn(df, 4), 4)
    recall = []
    for tables in (1, 4):
        family = H.sign_family(H.uniform_planes(6, 4, tables, 9))
        near = lsh.first_k(lsh.lsh_knn(df, 4, family), 4)
        assert lists(near) == lists(lsh.first_k(lsh.lsh_knn(df, 4, family), 4))
        recall.append(evaluate.neighbour_quality(near, exact).first()["recall"])
    assert recall[0] < recall[1]


@pytest.mark.parametrize("bits", [9, 40, 70])
def test_lonely_points_probe_whole_buckets(points, bits):
    x = RNG.normal(size=(80, 3))
    x[40] = -x[41]  # words that are opposite in every place
    family = H.sign_family(H.uniform_planes(3, bits, 1, 2))
    df, k = points(x), 4
    word = [r[0] for r in df.select(lsh._bits(family, F.col("x")), "i").orderBy("i").collect()]
    assert all(len(w) == bits for w in word)
    members = {}
    for i, w in enumerate(word):
        members.setdefault(w, []).append(i)
    want_share = np.zeros((80, 80), bool)
    for i, w in enumerate(word):
        space = list(members[w])
        if len(space) == 1:
            space = []
            for other in sorted(members, key=lambda o: (sum(a != b for a, b in zip(o, w)), o)):
                if other != w and len(space) < k:
                    space += members[other]
        want_share[i, space] = True
    assert any(len(m) == 1 for m in members.values())
    got = lists(lsh.lsh_knn(df, k, family, probe=True))
    assert got == brute.neighbours(x, k, allowed=want_share)


def test_probing_when_all_others_are_far(points):
    x = [[1.0, 2.0, 3.0], [-1.0, -2.0, -3.0]]
    family = H.sign_family(H.uniform_planes(3, 40, 1, 2))
    assert {i: list(n) for i, n in lists(lsh.lsh_knn(points(x), 4, family, probe=True)).items()} == {0: [1], 1: [0]}


def test_bucket_members_by_id(points):
    df = points(RNG.normal(size=(60, 2)))
    family = H.sign_family(H.uniform_planes(2, 2, 1, 4))
    rows = lsh.bucket_neighbours(df, 3, family).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["word"], []).append(r["i"])
    assert len(rows) == 60
    for r in rows:
        assert r["members"] == sorted(groups[r["word"]])[:3]


def test_radius_and_family_names(points):
    x = np.unique(RNG.integers(0, 30, size=(25, 2)), axis=0)
    nearest = [min(d.values()) for d in brute.neighbours(x, 1).values()]
    np.testing.assert_allclose(lsh.neighbour_radius(points(x), "euclidean"), 0.9 * np.mean(nearest))
    assert H.family("L2", 3, radius=0.01).name == "l2"
    with pytest.raises(ValueError, match="unknown hash family"):
        H.family("simhash", 3)
    with pytest.raises(ValueError, match="width"):
        H.l2_family(3, 1, 1, 0, 0)


def test_quality_of_known_lists(spark):
    kind = "i bigint, nbrs array<struct<dist: double, j: bigint>>"
    near = spark.createDataFrame([(0, [(1.0, 1), (2.0, 2)]), (1, [(1.0, 5)]), (2, [])], kind)
    exact = spark.createDataFrame([(0, [(1.0, 1), (2.0, 3)]), (1, [(1.0, 5), (2.0, 6)]), (2, [(1.0, 7)])], kind)
    row = evaluate.neighbour_quality(near, exact, 6).first()
    assert (row["tp"], row["fp"], row["fn"]) == (2, 1, 3)
    np.testing.assert_allclose(
        [row["precision"], row["recall"], row["correct_pct"], row["touched_pct"]],
        [200 / 3, 40, 200 / 3, 600 / 9],
    )


def test_planted_neighbours_are_found(spark):
    grown = synth.with_neighbours(synth.random_vectors(spark, 30, 8, 512, 1), 4, 1.0, 2)
    assert grown.select("i").distinct().count() == 150
    near = knn(grown, 4)
    own = near.select((F.size(F.filter("nbrs", lambda e: F.floor(e["j"] / 5) == F.floor(F.col("i") / 5))) == 4).alias("ok"))
    assert own.filter("not ok").count() == 0


def test_auc_and_curve(spark):
    score, label = RNG.integers(0, 20, 300).astype(float), RNG.integers(0, 2, 300)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    up, down = score[label == 1], score[label == 0]
    want = ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))
    np.testing.assert_allclose(evaluate.roc_auc(df).first()["auc"], want)
    curve = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df).collect())
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    np.testing.assert_allclose(area, want)


def test_sweep_picks_the_first_best(spark):
    rows = [(run, s, y) for run in (3, 5, 7) for s, y in ((0.0, 0), (1.0, 1 if run != 3 else 0), (2.0, 1))]
    df = spark.createDataFrame(rows, "run int, score double, label int")
    got = {r["run"]: (r["auc"], r["chosen"]) for r in evaluate.sweep(df, "run").collect()}
    assert got == {3: (1.0, True), 5: (1.0, False), 7: (1.0, False)}


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1.0, 1)], "score double, label int")
    assert evaluate.roc_auc(df).first()["auc"] is None


def test_distances_on_known_vectors(spark):
    row = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, o array<double>")
    a, b, o = F.col("a"), F.col("b"), F.col("o")
    got = row.select(
        M.euclidean(a, b), M.squared_euclidean(a, b), M.manhattan(a, b), M.cosine(a, b), M.cosine(a, o),
        M.intersection(a, b), M.intersection(o, o), M.dot(a, b),
        M.hamming_bits(F.lit(5), F.lit(3)), M.hamming_text(F.lit("abc"), F.lit("axc")),
        M.reach_distance(F.lit(2.0), F.lit(3.0)),
    ).first()
    assert got[:4] == (5.0, 25.0, 7.0, 1.0) and np.isnan(got[4])
    assert got[5:] == (1.0, 1.0, 0.0, 2, 1, 3.0)


def test_nearest_buckets_compare_blocks_not_pieces(points, monkeypatch):
    """Long words share short pieces with nearly all others; nothing is to be joined by them."""
    family, df = H.sign_family(H.uniform_planes(6, 60, 1, 3)), points(RNG.normal(size=(300, 6)))
    monkeypatch.setattr(lsh, "BLOCK_BITS", 5)
    words, made = lsh.bucket_words(df, family), {}
    plain = lsh.stage
    monkeypatch.setattr(lsh, "stage", lambda frame, name: made.setdefault(name, plain(frame, name)))
    chosen = lsh._nearest_buckets(words, df, 3, family)
    assert made["near-words"].count() <= 300 * 3 * 2  # k words for each point and tile, of 300
    held = chosen.join(words, "grp").groupBy("i").agg(F.sum("size").alias("held"))
    assert held.count() == 300 and held.filter("held < 3").count() == 0


@pytest.mark.parametrize("sides", [7, 16, 32, 33, 70])
@pytest.mark.parametrize("probe", [0, 4])
def test_words_are_looked_up_by_pieces(sides, probe, monkeypatch):
    """Few words are few bits apart; a look-up by pieces finds them, and all ties, as comparing all does."""
    monkeypatch.setattr(hamming, "PROBE", probe)
    monkeypatch.setattr(hamming, "VISIT", probe)
    monkeypatch.setattr(hamming, "GATHERED", 500)
    sizes = [min(32, sides - n) for n in range(0, sides, 32)]
    some = np.stack([RNG.integers(0, 1 << s, 300) for s in sizes], axis=1)
    some[100:200] = some[:100] ^ (1 << RNG.integers(0, min(sizes), (100, 1)))  # near, and in crowds of one piece
    words = np.unique(some, axis=0).astype(np.uint32)
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2, dtype=int)
    want = [(i, d, j) for i in range(len(words)) for d, j in sorted((d, j) for j, d in enumerate(apart[i]) if d)[:5]]
    near = hamming.NearWords(words, sides, 5)
    assert list(zip(*(c.tolist() for c in near.of(words)))) == want


def test_look_ups_visit_few_of_many_words(monkeypatch):
    """Comparing every word with all others is what took the time; hardly any is to be left to that."""
    words = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 60_000)).astype(np.uint32)[:, None]
    near, asked = hamming.NearWords(words, 32, 5), []
    plain = near.compared
    monkeypatch.setattr(near, "compared", lambda own, left: asked.append(len(left)) or plain(own, left))
    row, apart, _ = near.of(words[:2000])
    assert len(row) == 10_000 and sum(asked) < 200
    every = np.sort(np.bitwise_count(words[:50] ^ words.T).astype(int), axis=1)[:, 1:6]
    assert (apart[:250].reshape(50, 5) == every).all()


def test_probing_signs_once_and_leaves_out_lonely_buckets(points, monkeypatch):
    df, family, signed, rows = points(RNG.normal(size=(200, 4))), H.sign_family(H.uniform_planes(4, 40, 1, 2)), [], []
    wrapped = replace(family, signature=lambda x, t: signed.append(1) or family.signature(x, t))
    plain = lsh.knn
    monkeypatch.setattr(lsh, "knn", lambda some, *a, **b: rows.append(some.count()) or plain(some, *a, **b))
    assert lists(lsh.lsh_knn(df, 3, wrapped, probe=True)) == lists(lsh.lsh_knn(df, 3, family, probe=True))
    assert len(signed) == 1 and rows[0] < 200


@pytest.mark.parametrize("dims", [2, 20])
@pytest.mark.parametrize("skip_self", [True, False])
def test_small_groups_are_searched_together(points, dims, skip_self, monkeypatch):
    """A call for each of many small groups took most of a search's time."""
    x = RNG.integers(0, 4, size=(150, dims)).astype(float)
    groups = np.concatenate([RNG.integers(0, 40, 100), np.full(50, 99)])
    df = points(x).withColumn("grp", F.element_at(F.lit(groups.tolist()), (F.col("i") + 1).cast("int")).cast("bigint"))
    same = groups[:, None] == groups[None, :]
    for measure in ("euclidean", "cosine"):
        got = lists(knn(df, 3, measure, skip_self=skip_self))
        assert got == brute.neighbours(x, 3, measure, same, skip_self)
