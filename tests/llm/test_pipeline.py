"""The pipeline, stage by stage, against plain versions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farfield.llm import queries
from farfield.llm.common import stage
from tests.llm import brute, cases

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_every_stage_takes_effect(spark):
    sf = str(FOLDER)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs]
    for name, step in corpus_pipeline.STAGES:
        made.append(stage(step(spark, made[-1], sf), name))
    ids = [{r["doc_id"] for r in df.collect()} for df in made]
    assert all(df.columns == docs.columns for df in made[:5])
    toxic = {r["doc_id"] for r in queries.QUERIES["op10_toxicity"](spark, sf).filter("score >= 0.5").collect()}
    assert toxic and ids[1] == ids[0] - toxic
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = brute.components({i: brute.fingerprint(texts[i]) for i in ids[1]})
    assert ids[2] == set(groups.values())
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i in ids[2] if any(b in " ".join((texts[i] or "").split()) for b in items)}
    assert ids[3] == ids[2] - leaked
    size = lambda df: sum(len(brute.words(r["text"])) for r in df.collect())
    assert ids[4] <= ids[3] and abs(size(made[4]) - size(made[3])) < 0.05 * size(made[3])
    rows = made[5].collect()
    assert len(rows) == made[4].count()
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < 16


def test_own_columns_of_the_names_of_shards(spark):
    docs = cases.documents(spark).withColumn("Shard", F.lit("x")).withColumn("slot", F.lit(-1))
    rows = corpus_pipeline.sharded(spark, docs, "").collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r["shard"] < 16 and r["slot"] >= 0 and r["size"] == "x" for r in rows)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
