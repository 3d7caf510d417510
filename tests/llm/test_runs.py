"""Periodic runs against a scan of every period, and the suffix machinery against plain comparing."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from farfield.llm import queries, runs
from tests.llm import cases


def brute(words):
    """``start, length, period`` of all runs."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(24, 3 * p) and i > s:
                found.setdefault((s, i + p - s), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id, text):
    words = planted(doc_id, cases.words(text))
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapse(words, found)),
    )


def documents(rng):
    for _ in range(40):
        n, kind = int(rng.integers(0, 260)), rng.integers(0, 4)
        if kind == 0:
            yield rng.integers(0, 2, n).tolist()
        elif kind == 1:
            yield np.tile(rng.integers(0, 5, int(rng.integers(1, 40))), 20)[:n].tolist()
        elif kind == 2:
            yield np.concatenate([np.tile(rng.integers(0, 9, int(rng.integers(1, 30))), int(rng.integers(1, 8))) for _ in range(6)]).tolist()
        else:
            yield np.full(n, 7).tolist()


def test_the_cover_holds_every_difference():
    assert {(a - b) % runs.CYCLE for a in runs.COVER for b in runs.COVER} == set(range(runs.CYCLE))


def test_extensions_equal_comparing():
    rng = np.random.default_rng(1)
    ids = np.r_[np.concatenate([np.tile(rng.integers(0, 3, k), 9) for k in (1, 2, 5, 40, 3)] * 2), 99]
    reach, n = runs.Extensions(ids), len(ids)
    a, b = rng.integers(0, n, 4000), rng.integers(0, n, 4000)
    a, b = a[a != b], b[a != b]
    plain = [next(k for k in range(n) if ids[i + k] != ids[j + k]) if max(i, j) < n - 1 else 0 for i, j in zip(a, b)]
    assert reach(a, b).tolist() == plain


def test_runs_equal_a_scan_of_every_period(monkeypatch):
    rng = np.random.default_rng(2)
    for asked in (runs.ASKED, 50):
        monkeypatch.setattr(runs, "ASKED", asked)
        docs = list(documents(rng))
        docs += docs[:5]
        found, collapsed = runs._chunk([" ".join(f"w{x}" for x in d).encode() for d in docs])
        for d, got, text in zip(docs, found, collapsed):
            words = [f"w{x}" for x in d]
            assert [tuple(r.values()) for r in got] == brute(words)
            assert text.decode() == collapse(words, brute(words))
        assert sum(map(len, found)) > 20


def test_a_long_document_and_many_copies():
    unit = [f"u{k}".encode() for k in range(700)]
    long = b" ".join(unit * 90)
    found, collapsed = runs._chunk([long] * 4 + [b" ".join(unit)])
    assert found[:4] == [[{"start": 0, "length": 63_000, "period": 700}]] * 4 and found[4] == []
    assert collapsed == [b" ".join(unit)] * 5


def test_odd_rows_and_no_rows(spark):
    extra = [(20, "no pattern here"), (21, "tick tock " * 12), (21, "tick tock " * 12), (22, "a" + "\n\t a" * 23), (23, "a " * 23)]
    docs = cases.documents(spark, [*cases.TEXTS, *extra]).withColumn("runs", F.lit("x")).withColumn("text_", F.lit(1))
    got = runs.searched(docs).select("row.doc_id", "row.runs", "row.text", F.col("runs").alias("found"), "collapsed").collect()
    assert len(got) == len(cases.TEXTS) + len(extra)
    for r in got:
        words = cases.words(r["text"])
        assert [tuple(x) for x in r["found"]] == (found := brute(words) if len(words) < 5000 else []) and r["runs"] == "x"
        assert r["collapsed"] == collapse(words, found)
    by_id = {r["doc_id"]: r["found"] for r in got}
    assert [tuple(x) for x in by_id[21]] == [(0, 24, 2)] and len(by_id[22]) == 1 and by_id[23] == []
    assert runs.searched(cases.nothing(spark)).count() == 0


def test_the_query_equals_the_contract(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(f"v{x}" for x in rng.zipf(1.3, int(rng.integers(0, 400))))) for k in range(300)]
    texts += [(300 + k, t) for k, (_, t) in enumerate(cases.TEXTS) if t is None or len(t) < 10_000] + [(None, "a " * 30)]
    cases.documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=key) == sorted((digest(i, t) for i, t in texts), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 10
