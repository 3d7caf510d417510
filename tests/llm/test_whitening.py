"""Whitening against eigenvectors of the whole covariance."""

import math
from pathlib import Path

import numpy as np
import pytest

from farfield.llm import queries, whitening
from farfield.llm.common import stage


def points(spark, x, extra=()):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate([*x, *extra])]
    return stage(spark.createDataFrame(rows, "i bigint, x array<double>"), "points")


def plain(x, k):
    x = np.asarray(x, float)
    off = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(off.T @ off / len(x))
    return off, values[::-1][:k], vectors[:, ::-1][:, :k]


SPECTRA = {
    "falling": 0.9 ** np.arange(40), "flat": 1 + 0.01 * np.arange(40)[::-1], "two high": np.r_[1e4, 1e2, np.ones(38)],
    "low rank": np.r_[5.0, 4, 3, np.zeros(37)], "few dimensions": np.r_[3.0, 2, 1],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_equal_the_whole_decomposition(spark, name):
    rng = np.random.default_rng(4)
    spread = SPECTRA[name]
    d = len(spread)
    x = rng.normal(size=(400, d)) * np.sqrt(spread) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 100
    junk = [None, [None] * d, [math.nan] * d, [math.inf] * d, []]
    df = points(spark, x, junk)
    model = whitening.fit(df, components=5)
    off, values, vectors = plain(x, 5)
    keep = int((values > 1e-9 * values[0]).sum())
    assert model.n == 400 and len(model.values) == keep == min(5, d, int((spread > 0).sum()))
    assert np.allclose(model.values, values[:keep], rtol=1e-10) and model.residual <= 100 * whitening.CERTIFIED
    made = stage(whitening.whitened(df, model), "made")
    got = made.orderBy("i").toPandas()
    assert got["i"].tolist() == list(range(400))
    w, want = np.array(got["w"].tolist()), off @ vectors[:, :keep] / np.sqrt(values[:keep])
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)
    assert whitening.identity_error(made, keep) < 1e-9


def test_no_points_equal_points_and_ragged_points(spark):
    for x in ([], [[1.0, 2.0]] * 3, [None]):
        model = whitening.fit(points(spark, x))
        assert len(model.values) == 0 and model.n == (3 if len(x) == 3 else 0)
        made = stage(whitening.whitened(points(spark, x), model), "made")
        assert [r["w"] for r in made.collect()] == [[]] * model.n and whitening.identity_error(made, 0) == 0
    with pytest.raises(ValueError, match="of 1 and of 2 dimensions"):
        whitening.fit(points(spark, [[1.0], [1.0, 2.0]]))


def _written(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, x string, w string").write.parquet(f"{folder}/embeddings.parquet")


def test_the_query_equals_the_contract(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 12)).astype(np.float32)
    x[100:120] = x[:20]  # repeated rows
    rows = [(k, v.tolist(), 1, "x", "w") for k, v in enumerate(x)]
    rows += [(200, None, None, None, None), (201, [None] * 12, 1, "", ""), (202, [float("nan")] * 12, 1, "", ""), (None, x[3].tolist(), 1, "", "")]
    _written(spark, tmp_path, rows)
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path)).toPandas()
    whole = np.floor(1024 * np.r_[x, x[3:4]].astype(np.float64)).astype(object).astype(int) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    off, values, vectors = plain(whole, 8)
    assert len(got) == n * 8 and (got["n"] == n).all() and got["identity_error"].max() < 1e-8
    total = np.linalg.eigvalsh(off.T @ off / n).sum()
    deviation = ((n * whole - sums) ** 2).sum(axis=1)
    for c, part in got[got["vec_id"].notna()].groupby("component"):
        at = part["vec_id"].astype(int).to_numpy()
        want = off[at] @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        w = part["whitened"].to_numpy()
        assert np.allclose(w * np.sign(w @ want), want, atol=1e-8)
        assert np.allclose(part["explained"], values[c - 1] / total, rtol=1e-9)
        assert (part["deviation"].to_numpy() == deviation[at]).all()


def test_the_query_on_no_rows(spark, tmp_path):
    _written(spark, tmp_path, [])
    assert queries.QUERIES["op11_whitening"](spark, str(tmp_path)).count() == 0
    assert Path(tmp_path).exists()
