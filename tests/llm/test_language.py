"""Letter profiles: vectors, odd rows, a plain version, held-out accuracy."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from farfield.llm import language, queries
from tests.llm import cases

FOLDER = Path("/root/testdata/sf0.01")


def letters(text):
    low = [c.lower()[0] if c.isalpha() else " " for c in text]
    return "".join(c for k, c in enumerate([" ", *low, " "]) if c != " " or k == 0 or ([" ", *low][k - 1] != " "))


def plain(text, dims):
    """The bundle of a text, triple by triple."""
    sign = lambda c: np.random.default_rng([language.SEED, 0 if c == " " else ord(c)]).integers(0, 2, dims, dtype=np.int8) * 2.0 - 1
    total, line = np.zeros(dims), letters(text)
    for k in range(1, len(line) - 1):
        if line[k] != " ":
            total += np.roll(sign(line[k - 1]), 2) * np.roll(sign(line[k]), 1) * sign(line[k + 1])
    return total / n if (n := np.linalg.norm(total)) else total


def test_bundles_equal_a_plain_sum(monkeypatch):
    texts = ["The cat, the hat.", "", "a", "Ünï-cødé Œuvre 3x3", " \n\t", "word " * 50, "ß İ ǅ 漢字 한글"]
    table = language._letters()
    for triples in (language.TRIPLES, 5):
        monkeypatch.setattr(language, "TRIPLES", triples)
        got = language._bundles(texts, table, 256, language.SEED)
        assert np.allclose(got, [plain(t, 256) for t in texts], atol=1e-5)
    assert len(list(language._parts(["x" * language.PART] * 3 + ["y"] * 9))) == 4


def test_fit_and_score_equal_a_plain_version(spark):
    said = {"xx": ["abab baba abba", "bab aba"], "yy": ["cdcd dcdc cddc", "dcd cdc"]}
    rows = [(k, t, lang) for lang, texts in said.items() for k, t in enumerate(texts * 8, 100 if lang == "yy" else 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs, dims=512)
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for k, lang in enumerate(("xx", "yy")):
        want = sum(plain(t, 512) for _, t, x in learn if x == lang)
        assert np.allclose(model["profiles"][k], want / np.linalg.norm(want), atol=1e-4)
    assert 0 < len(learn) < len(rows)
    mean = model["profiles"].mean(axis=0)
    apart = [p - mean for p in model["profiles"]]
    for r in language.identified(docs, model).select("row.text", "row.lang", "lang_pred", "score").collect():
        mine = plain(r["text"], 512) - mean
        cosines = [mine @ p / np.linalg.norm(mine) / np.linalg.norm(p) for p in apart]
        assert r["lang_pred"] == r["lang"] and r["score"] == pytest.approx((1 + max(cosines)) / 2, abs=1e-4)


def test_odd_rows_and_no_rows(spark):
    docs = cases.documents(spark).withColumn("lang_pred", F.lit("own"))
    for model in (language.fit(docs, dims=256), language.fit(cases.nothing(spark), dims=256)):
        got = language.identified(docs, model).select("row.*", F.col("lang_pred").alias("found"), F.col("score").alias("sure")).collect()
        assert len(got) == len(cases.TEXTS)
        for r in got:
            has = any(c.isalpha() for c in r["text"] or "") and bool(model["langs"])
            assert r["found"] == ("en" if has else language.NONE) and r["lang_pred"] == "own"
            assert 0 <= r["sure"] <= 1 and (has or r["sure"] == 0)
    assert language.identified(cases.nothing(spark), model).count() == 0
    # copies and equal texts get equal answers
    assert len({r["sure"] for r in got if r["text"] == cases.PROSE}) == 1


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_held_out_documents_are_told_apart(spark):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op12_language_id"](spark, str(FOLDER)).join(known, "doc_id").filter("lang is not null").toPandas()
    held = got[got["held_out"]]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
