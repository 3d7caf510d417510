"""More labels than a sample takes must not change verdicts."""

import random

import numpy as np

from farfield.llm import cnn, toxicity
from tests.llm import cases


def corpus(spark, bad, good):
    """Texts with zero to two telling words, more often in bad ones, with labels."""
    rng, rows = random.Random(1), []
    for k in range(bad + good):
        y = int(k < bad)
        said = ["hello", "river", "mill", "grave"] * 5 + ["zounds"] * rng.choice([0, 1, 1, 2] if y else [0, 0, 0, 0, 0, 0, 1, 2])
        rng.shuffle(said)
        rows.append((k, " ".join(said), y))
    docs = cases.documents(spark, [(k, t) for k, t, _ in rows])
    return docs, spark.createDataFrame([(k, 1 - y, y) for k, _, y in rows], "doc_id bigint, quality int, toxic int")


def test_a_capped_sample_keeps_the_shares(spark, monkeypatch):
    docs, labels = corpus(spark, 150, 1350)
    line = {}
    for most in (4000, 100):
        sample = toxicity.labelled
        monkeypatch.setattr(toxicity, "labelled", lambda d, l, c, most=most: sample(d, l, c, most))
        line[most] = np.array(toxicity.fit(docs, labels)["line"])
        monkeypatch.setattr(toxicity, "labelled", sample)
    # log odds of texts without, and with one, telling word
    for signals in ((0.0, 0.0), toxicity.signals(3.0, 21)):
        whole, capped = (line[m] @ [1, *signals] for m in (4000, 100))
        assert abs(whole - capped) < 0.8, (whole, capped)


def test_the_network_keeps_the_shares(spark, monkeypatch):
    docs, labels = corpus(spark, 60, 540)
    monkeypatch.setattr(cnn, "SAMPLE", 40)
    monkeypatch.setattr(cnn, "train", lambda texts, ys, shares: [sum(s for y, s in zip(ys, shares) if y == c) for c in (0, 1)])
    bad, good = cnn.fit(docs, labels)["net"]
    known = labels.filter(~toxicity.held_out()).groupBy("quality").count().collect()
    known = {r["quality"]: r["count"] for r in known}
    assert abs(good / bad - known[1] / known[0]) < 1e-6


def test_weights_of_documents_move_the_network():
    texts, ys = [b"same words in each of them"] * 20, [0, 1] * 10
    even, tilted = (cnn.logit(cnn.train(texts, ys, s), texts[0]) for s in (None, [9.0, 1.0] * 10))
    assert tilted < even - 1
