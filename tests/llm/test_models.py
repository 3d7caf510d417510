"""The toxicity lexicon and the byte network: parts, odd rows, held-out accuracy."""

import time
from pathlib import Path

import numpy as np
import pytest

from farfield.llm import cnn, queries, toxicity
from tests.llm import cases

FOLDER = Path("/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("said", ["idiot", "IDIOT!", "1d10t", "idi0t", "іdіоt", "ｉｄｉｏｔ", "i​d­iot", "idiot###", "(idiot)", "the idiot."])
def test_disguises_are_folded(said):
    assert " idiot " in toxicity.folded(said)


def test_numbers_and_addresses_stay_apart():
    assert toxicity.folded("on 10 May 2010, 5 of 8") == " on may of "
    assert toxicity.folded("") == "  " and toxicity.folded("12 !!") == "  "


def test_weights_and_exceptions():
    model = {"weights": {" idiot ": 4.0, " idi": 2.0, " trash ": 3.0}, "exceptions": [" trash can ", " idiom "]}
    matcher = toxicity._matcher(model)
    weigh = lambda t: toxicity._weight(toxicity.folded(t), matcher)
    assert weigh("an idiot and idiocy") == (6.0, 4)
    assert weigh("a trash can") == (0.0, 3) and weigh("such trash") == (3.0, 2)
    assert weigh("an idiom") == (0.0, 2) and weigh("") == (0.0, 0)
    few, many = toxicity.signals(4.0, 10), toxicity.signals(4.0, 1000)
    assert few[0] == many[0] and few[1] > many[1]


def test_models_on_odd_and_no_rows(spark):
    docs = cases.documents(spark)
    for none in (labels(spark), labels(spark, [(1, None, None), (None, 1, 1), (7, 1, 1)])):
        for module, label in ((toxicity, "toxic"), (cnn, "quality")):
            rows = module.scored(docs, module.fit(docs, none, label)).select("row.text", "row.score", "score").toDF("text", "own", "score").collect()
            assert len(rows) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 and r["own"] == "x" for r in rows)
            assert len({r["score"] for r in rows if r["text"] == cases.PROSE}) == 1
    model = toxicity.fit(cases.nothing(spark), labels(spark))
    assert toxicity.scored(cases.nothing(spark), model).count() == 0
    odd = cases.documents(spark, [*cases.TEXTS, (90, "you are a stupid 1d10t")])
    kept = toxicity.kept(odd, labels(spark))
    assert kept.columns == odd.columns and kept.count() == len(cases.TEXTS)
    assert cnn.scored(cases.nothing(spark), {"share": 0.5, "net": None}).count() == 0


def plain_weight(line, model):
    """Every start of a term by substring search, its heaviest weight, unless an exception covers it."""
    at = lambda t: [k for k in range(len(line)) if line.startswith(t, k)]
    spared = {s for t in model["exceptions"] for k in at(t) for s in range(k, k + len(t) - 1)}
    best = {}
    for t, w in model["weights"].items():
        for k in at(t):
            best[k] = max(w, best.get(k, 0.0))
    return sum(w for k, w in best.items() if k not in spared)


def test_weights_equal_a_plain_scorer():
    model = {
        "weights": {" trash ": 4.0, " clown ": 3.0, " tra": 1.5, " can ": 1.0, " c": 0.5},
        "exceptions": [" trash can ", " clown trash ", " can ", " clown trash can trash "],
    }
    matcher, rng = toxicity._matcher(model), np.random.default_rng(3)
    for _ in range(300):
        line = toxicity.folded(" ".join(rng.choice(["trash", "clown", "can", "cat", "travel", "x"], rng.integers(0, 12))))
        assert toxicity._weight(line, matcher)[0] == pytest.approx(plain_weight(line, model))


def test_thousands_of_exceptions_in_one_text():
    model = {"weights": {" trash ": 4.0, " clown ": 3.0}, "exceptions": [" trash can "]}
    matcher, begun = toxicity._matcher(model), time.process_time()
    assert toxicity._weight(toxicity.folded("clown trash can " * 100_000), matcher) == (300_000.0, 300_000)
    assert time.process_time() - begun < 20  # a pass over all hits for each phrase takes minutes


def test_a_lexicon_is_whole_or_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in "cab"], "term string")
    assert [r["term"] for r in toxicity._whole(rows)] == ["a", "b", "c"]
    monkeypatch.setattr(toxicity, "LARGEST", 2)
    with pytest.raises(ValueError, match="more than 2 terms"):
        toxicity._whole(rows)


def test_the_way_back_is_the_slope():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in cnn._start(rng).items()}
    data, y = cnn._padded(bytes(rng.integers(0, 256, 700, dtype=np.uint8))), 1.0

    def loss(q):
        top = cnn._chunks(q, data)[2]
        z = cnn._numbers(q, np.maximum(top[:-1], top[1:]))[1]
        out = q["w"][0] * z.mean() + q["w"][1] * z.min() + q["w"][2]
        return np.log1p(np.exp(out)) - y * out

    g = {k: np.zeros_like(v) for k, v in p.items()}
    cnn._gradients(p, data, y, 1.0, g)
    for k in p:
        for _ in range(6):
            at, e = tuple(rng.integers(0, n) for n in p[k].shape), 1e-5
            more, less = ({**p, k: p[k].copy()} for _ in range(2))
            more[k][at] += e
            less[k][at] -= e
            assert g[k][at] == pytest.approx((loss(more) - loss(less)) / (2 * e), abs=2e-3)


def test_long_documents_are_read_whole():
    p = cnn._start(np.random.default_rng(1))
    data = cnn._padded(b"ab" * 900_000)
    assert np.allclose(cnn._tops(p, data), cnn._chunks(p, data)[2], atol=1e-5)
    assert cnn.logit(p, b"a" * 3_000_000 + b"\xff" * 200) != cnn.logit(p, b"a" * 3_000_200)


@needs_tables
@pytest.mark.parametrize("name, label", [("op7_quality_network", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_documents_are_told_apart(spark, name, label):
    rated = queries.QUERIES[name](spark, str(FOLDER))
    known = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label)
    rows = rated.filter("held_out").join(known, "doc_id").select("score", label).collect()
    up, down = ([r["score"] for r in rows if r[label] == y] for y in (1, 0))
    wins = np.mean([[(a > b) + 0.5 * (a == b) for b in down] for a in up])
    # junk that is marked toxic without a telling word cannot be told: two of six here
    assert wins > (0.9 if label == "quality" else 0.8)
