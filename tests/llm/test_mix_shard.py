"""Mixing and sharding."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from farfield.llm import mixing, sharding
from tests.llm import brute, cases


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1000, 1, 1], [0, 0, 7], [3], [10, 200, 3000, 40, 5, 6, 70], [0], [1] * 40 + [4000]])
def test_targets_equal_step_by_step_sharing(spark, sizes):
    named = {f"s{k:02d}": n for k, n in enumerate(sizes)}
    got = mixing.targets(spark.createDataFrame(list(named.items()), "s string, source_size bigint")).collect()
    want = brute.targets(named)
    assert {r["s"]: pytest.approx(r["target"], rel=1e-12) for r in got} == want


@pytest.mark.parametrize("block, shards", [(1, 1), (3, 4), (16, 5), (10_000, 3)])
def test_quotas_are_seats_by_highest_quotients(spark, block, shards):
    aimed = {f"s{k}": float(n) for k, n in enumerate([500, 500, 90, 7, 0, 1200, 33])}
    df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(aimed.items())], "s string, target double, rank int")
    got = defaultdict(Counter)
    for r in mixing.quotas(df, block, shards).collect():
        got[r["shard"]][r["s"]] += r["seats"]
    house, before = int(sum(aimed.values()) / block + 0.5), Counter()
    seen = {s: t for s, t in aimed.items() if t > 0}
    for j in range(shards):
        upto = brute.seats(seen, int(house * (j + 1) / shards + 0.5))
        assert {s: upto[s] - before[s] for s in seen} == {s: got[j][s] for s in seen}
        before = Counter(upto)


def test_mix(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(f"w{j}" for j in range(rng.randrange(300)))) for k in range(600)]
    docs = cases.documents(spark, texts).withColumn(
        "source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") < 350, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3))
    )
    rows = mixing.mixed(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    again = mixing.mixed(docs.repartition(5)).select("row.doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["size"] == len(brute.words(dict(texts)[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(sizes[r["source"]] == r["source_size"] for r in rows)
    assert target == {s: pytest.approx(t) for s, t in brute.targets(dict(sizes)).items()}
    assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK for s in target)
    made = Counter()
    out = mixing.applied(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        made[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert made == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_mix_of_odd_and_no_rows(spark):
    docs = cases.documents(spark)
    rows = mixing.mixed(docs).select("row.text", "row.size", F.col("size").alias("n"), "taken").collect()
    assert len(rows) == len(cases.TEXTS)
    assert all(r["n"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 3 * r["n"] and r["size"] == "x" for r in rows)
    assert mixing.mixed(cases.nothing(spark)).count() == 0 and mixing.applied(cases.nothing(spark)).count() == 0
    assert mixing.mixed(cases.documents(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_shards_keep_to_their_law(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    some = docs.select(sharding.shard_of(F.col("doc_id"), 16).alias("a"), sharding.shard_of(F.col("doc_id"), 17).alias("b")).collect()
    assert all(r["b"] in (r["a"], 16) for r in some) and len({r["a"] for r in some}) == 16
    assert 120 < sum(r["b"] == 16 for r in some) < 360


def test_written_shards(spark, tmp_path):
    rng = random.Random(5)
    texts = [(k, "x" * rng.randrange(3000)) for k in range(1500)] + [(7, "copy" * 50)] * 700
    docs = cases.documents(spark, texts)
    first = sharding.written(docs, str(tmp_path / "a"), shards=4, bucket_bytes=64 << 10)
    place = lambda df: sorted((r["_shard"], r["slot"], r["doc_id"], r["text"]) for r in df.select("_shard", "slot", "row.doc_id", "row.text").collect())
    rows = place(first)
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for s, k, _, _ in rows:
        slots[s].append(k)
    assert all(v == list(range(len(v))) for v in slots.values())
    again = place(sharding.written(docs, str(tmp_path / "b"), shards=4, bucket_bytes=64 << 10))
    assert rows == again
    order = [i for s, _, i, _ in rows if s == 0]
    assert order != sorted(order)
    sizes = [r["n"] for r in first.groupBy("_shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4


def test_shards_of_odd_and_no_rows(spark):
    docs = cases.documents(spark)
    rows = sharding.written(docs).select("row.*", F.col("_shard").alias("mine"), "slot").collect()
    assert len(rows) == len(cases.TEXTS) and all(r["_shard"] == "x" for r in rows)
    assert len({r["mine"] for r in rows if r["doc_id"] is None}) == 1
    assert sorted(str(r["text"])[:50] for r in rows) == sorted(str(t)[:50] for _, t in cases.TEXTS)
    assert sharding.written(cases.nothing(spark)).count() == 0
