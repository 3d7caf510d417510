"""Near-duplicates, decontamination and licences."""

import random

import pytest

from farfield.llm import decontamination, licences, simhash
from tests.llm import brute, cases


def test_fingerprints_equal_a_plain_count(spark):
    got = simhash.fingerprinted(cases.documents(spark)).select("row.text", "fp").collect()
    assert len(got) == len(cases.TEXTS)
    for r in got:
        if r["text"] != cases.LONG:
            assert r["fp"] & (2**64 - 1) == brute.fingerprint(r["text"]), r["text"]


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("kind", ["random", "chain", "ball", "shared piece"])
def test_links_join_what_all_pairs_join(spark, kind):
    rng = random.Random(kind)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    if kind == "random":
        base = [rng.getrandbits(64) for _ in range(400)]
        values = base + [flip(rng.choice(base), rng.randrange(1, 5)) for _ in range(800)] + [0, 2**64 - 1]
    elif kind == "chain":
        values = [rng.getrandbits(64)]
        for _ in range(300):
            values.append(flip(values[-1], 2))
    elif kind == "ball":
        values = [flip(12345678901234567890, rng.randrange(4)) for _ in range(1500)]
    else:
        values = [(0b1011 << 60) | rng.getrandbits(14) for _ in range(1200)]
    values = sorted(set(values))
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    edges = simhash.links(nodes)
    pairs = [(r["u"], r["v"]) for r in edges.collect()]
    assert all((u ^ v).bit_count() <= 64 for u, v in pairs)
    assert len(pairs) <= 40 * len(values)
    roots = {r["u"]: r["root"] for r in simhash.components(edges).collect()}
    got = {v: roots.get(signed(v), signed(v)) for v in values}
    want = brute.components({v: v for v in values})
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[v], want[v]) for v in values}) == len(set(want.values()))


def test_components_of_plain_graphs(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100), (200, 201), (201, 200), (300, 301), (300, 301)] + [(400, k) for k in range(401, 480)]
    got = simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    roots = {r["u"]: r["root"] for r in got}
    assert all(roots[k] == 0 for k in range(1, 51)) and roots[201] == 200 and roots[301] == 300
    assert all(roots[k] == 400 for k in range(401, 480)) and 100 not in roots
    assert simhash.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_on_odd_and_no_rows(spark):
    rows = simhash.with_component_ids(cases.documents(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    ids = {}
    for r in rows:
        ids.setdefault(r["fp"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in ids.values()) and ids[0] == {1}
    docs = cases.documents(spark)
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert [i for i, t in left if t == cases.PROSE] == [7] and [i for i, t in left if not cases.words(t)] == [1]
    assert simhash.kept(cases.nothing(spark)).count() == 0
    alone = simhash.kept(cases.documents(spark, [(None, "a b"), (None, "a b")])).collect()
    assert len(alone) == 1


ITEM = "A train leaves Paris at 9 with 120 people and travels 300 km to Lyon, where Marie counts 45 of them leaving the train."
OTHER = ITEM.replace("Paris", "Rome").replace("Lyon", "Naples").replace("Marie", "Paolo").replace("120", "77").replace("300 km", "210 miles").replace("45", "12")
MIXED = "A train leaves Bern at 9 with 5 people and travels 6 km to Rome. A train leaves Oslo at 2 with 8 people"
PLAIN = "Which of the following birds can not fly but swims very well in the cold seas of the south, hunting for small fish?"


def items(spark, rows=((1, ITEM), (2, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, "short one"), (None, None))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_leaks_are_found(spark):
    lead = "some unrelated words stand here before it. "
    texts = [
        (20, lead + ITEM), (21, lead + OTHER + " and more follows"), (22, lead + PLAIN.lower()),
        (23, lead + PLAIN.replace("very well", "quite well")), (24, " ".join(PLAIN.split()[:12])), (25, lead + MIXED),
        (26, "Short one!"), (27, lead + "short one"), (28, (lead + ITEM + " ") * 3), (29, " ".join(reversed(PLAIN.split()))),
        (30, PLAIN.replace(" birds", "\n birds")), *cases.TEXTS,
    ]
    docs = cases.documents(spark, texts)
    rows = decontamination.leaks(docs, items(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [
        (20, 1), (21, 1), (22, 2), (23, 2), (26, 5), (28, 1), (30, 2)
    ]
    by = {r["doc_id"]: r for r in rows}
    assert by[20]["n_changed"] == 0 and by[20]["n_slots"] >= 7 and by[21]["n_changed"] >= 6
    kept = decontamination.kept(docs, items(spark))
    assert kept.columns == docs.columns and kept.count() == len(texts) - 7
    for a, b in ((cases.nothing(spark), items(spark)), (docs, items(spark, []))):
        assert decontamination.leaks(a, b).count() == 0 and decontamination.kept(a, b).count() == a.count()


def test_values_must_change_as_one(spark):
    item = "If Anna gives Bert 3 apples and then Bert gives Anna 5 pears, how many fruits does Anna have when Bert has 3 apples?"
    same = item.replace("Anna", "Cleo").replace("Bert", "Dora").replace("3", "8")
    names = iter(["Ada", "Bob", "Cid", "Dan", "Eve", "Flo", "Gil"])
    torn = " ".join(next(names) if w in ("Anna", "Bert") else w for w in item.replace("3", "{}").format(1, 2).split())
    rows = decontamination.leaks(cases.documents(spark, [(1, same), (2, torn)]), items(spark, [(1, item)])).collect()
    assert [r["doc_id"] for r in rows] == [1]


def test_licences(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.txt", "plain words here"), ("a/b/y.txt", "more words"),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z.txt", None),
        ("a/b/own.txt", "first line\n# Licensed under the Apache License, Version 2.0.\nlast"), ("q/x.txt", ""), (None, "words"),
        ("two.txt", "text\nLicensed under CC BY-NC 4.0.\nmore\nReleased under the MIT License."), ("q/x.txt", ""),
        ("no.txt", "The licence of the house is in the hands of the general public."), ("x" * 10, cases.LONG),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, headers string")
    got = [(r["path"], r["licence"], r["origin"]) for r in licences.inherited(licences.scanned(df)).collect()]
    assert sorted(got, key=str) == sorted([
        ("a/LICENSE", "MIT", None), ("a/x.txt", "MIT", "a"), ("a/b/y.txt", "MIT", "a"), ("a/b/c/COPYING", "GPL-3.0", None),
        ("a/b/c/d/z.txt", "GPL-3.0", "a/b/c"), ("a/b/own.txt", "Apache-2.0", None), ("q/x.txt", None, None), ("q/x.txt", None, None),
        (None, None, None), ("two.txt", "CC-BY-NC-4.0 AND MIT", None), ("no.txt", None, None), ("x" * 10, None, None),
    ], key=str)
    assert licences.inherited(licences.scanned(df.limit(0))).count() == 0
