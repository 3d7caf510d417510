"""Hash buckets of a growing set, kept between micro-batches.

Every batch adds the buckets of its own points, once: a row per point and table, in folders
by the leading bits of the bucket.  Arrivals read only the folders in which buckets of theirs
lie, and of these only the rows that share a bucket with one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.functions.hashing import Family
from farfield.functions.measures import Measure
from farfield.operators.knn import CANDIDATE, QUERY, keep_nearest
from farfield.operators.lsh import bucket_rows, bucket_words, first_k, search_buckets
from farfield.session import stage
from farfield.streaming.state import Versions

ROWS = "i bigint, x array<double>, tab int, grp bigint, part int"
WORDS = "word string, grp bigint, size bigint"
#: A folder is to hold about so many rows, but there are at most ``1 << MOST_BITS`` of them.
FOLDER_ROWS, MOST_BITS = 1 << 18, 10


def _part(bits: int) -> Column:
    return F.shiftrightunsigned("grp", 64 - bits).cast("int")


def _written(versions: Versions, name: str, batch_id: int, rows: DataFrame, count: int) -> dict:
    bits = min(MOST_BITS, max(1, (count // FOLDER_ROWS).bit_length()))
    # by bucket, then point: a bucket that holds a large share of the rows is several tasks' work
    spread = rows.withColumn("part", _part(bits)).repartitionByRange(1 << bits, "grp", "i")
    return {"buckets": versions.write(name, batch_id, spread, "part"), "bits": bits, "bucket_rows": count}


def build(versions: Versions, batch_id: int, points: DataFrame, count: int, hashed: Family, probe: bool) -> dict:
    """Write the buckets of ``count`` points; what the manifest is to say of them.  With ``probe``,
    also how many points share each word of the first table."""
    rows = bucket_rows(points, hashed).select("i", "x", "tab", "grp")
    entry = _written(versions, "buckets", batch_id, rows, count * hashed.tables)
    if probe:
        entry["words"] = versions.write("words", batch_id, bucket_words(points, hashed))
    return entry


def stored(versions: Versions, segments: list[dict]) -> DataFrame:
    """All rows of segments; each has folders of its own."""
    parts = [versions.read([s["buckets"]], ROWS) for s in segments]
    return reduce(DataFrame.unionByName, parts) if parts else versions.read([], ROWS)


def merge(versions: Versions, batch_id: int, segments: list[dict]) -> dict:
    """One segment of buckets from several; nothing is hashed again."""
    rows = stored(versions, segments).drop("part")
    entry = _written(versions, "buckets-merged", batch_id, rows, sum(s["bucket_rows"] for s in segments))
    if "words" in segments[0]:
        entry["words"] = versions.write("words-merged", batch_id, _words(versions, segments))
    return entry


def _words(versions: Versions, segments: list[dict]) -> DataFrame:
    rows = versions.read([s["words"] for s in segments], WORDS)
    return rows.groupBy("word", "grp").agg(F.sum("size").alias("size"))


def members(versions: Versions, segments: list[dict], asked: DataFrame) -> DataFrame:
    """The stored rows ``i, x, tab, grp`` of the buckets ``asked(grp)``."""
    # numbers of folders: at most 1 << MOST_BITS
    folders = [r["part"] for r in asked.select(_part(MOST_BITS).alias("part")).distinct().collect()]
    parts = []
    for s in segments:
        rows = versions.read([s["buckets"]], ROWS)
        parts.append(rows.filter(F.col("part").isin(sorted({f >> (MOST_BITS - s["bits"]) for f in folders}))))
    if not parts:
        return versions.read([], ROWS).drop("part")
    return reduce(DataFrame.unionByName, parts).drop("part").join(asked, "grp", "left_semi")


def find(
    versions: Versions,
    segments: list[dict],
    own: dict,
    arriving: DataFrame,
    k: int,
    measure: str | Measure,
    hashed: Family,
    probe: bool,
) -> DataFrame:
    """Lists ``i, nbrs`` of the arriving points, whose buckets ``own`` names, among all points.

    With ``probe``, ties are kept and points alone in their buckets search the nearest ones; else
    lists have at most ``k`` entries.
    """
    mine = versions.read([own["buckets"]], ROWS)
    asked = stage(mine.select("grp").distinct(), "asked")
    rows = mine.select("i", "x", "grp", F.lit(QUERY | CANDIDATE).alias("role")).unionByName(
        members(versions, segments, asked).select("i", "x", "grp", F.lit(CANDIDATE).alias("role"))
    )
    every = [*segments, own]
    words = stage(_words(versions, every), "words") if probe else None
    found = search_buckets(
        rows, arriving, k, hashed, measure, words, lambda wanted: members(versions, every, stage(wanted, "wanted"))
    )
    return (found if probe else keep_nearest(first_k(found, k), k)).select("i", "nbrs")
