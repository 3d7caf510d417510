"""The registry keeps its contract, and a sample of it agrees with its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
SAMPLE = [
    "lof_with_copies", "knn_with_ties", "linear_top_k", "box_join", "vector_distances", "parsed_documents",
    "lsh_l2", "neighbour_quality", "absorbed_areas", "roc_curve", "profile_audit",
]

needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["lof"] for r in rows] == sorted((r["lof"] for r in rows), reverse=True)


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(FOLDER))
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    expected = [tuple(r[c] for c in order) for r in want.fetchall()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
