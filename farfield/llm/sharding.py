"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes into buckets small enough for a task's memory.
Pass two shuffles each bucket by Fisher-Yates and writes it.  A shard is a set of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farfield.llm.common import stage
from farfield.session import scratch_dir

SHARDS = 16
SEED = 11
BUCKET_BYTES = 8 << 20


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest seeded hash: one shard more takes rows only into itself.

    Ids and the number of shards alone decide.  A null id is an id of its own.
    """
    draw = lambda j: F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(j)), F.lit(j))
    return F.greatest(*(draw(j) for j in range(shards)))["col2"] if shards > 1 else F.lit(0)


def _fisher_yates(seed: int):
    def shuffled(bucket):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # Rows come in any order; the shuffle starts from a fixed one, so that a task
        # that runs again writes the same rows in the same places.
        order = pc.sort_indices(bucket, [("_tie", "ascending"), ("_text", "ascending")]).to_numpy()
        shard, part = bucket["_shard"][0].as_py(), bucket["_bucket"][0].as_py()
        draw, n = np.random.default_rng([seed, shard, part]), len(order)
        picks = draw.integers(0, np.arange(1, n + 1)).tolist()
        order = order.tolist()
        for k in range(n - 1, 0, -1):
            j = picks[k]
            order[k], order[j] = order[j], order[k]
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        return bucket.drop_columns(["_tie", "_text"]).append_column("_place", pa.array(place)).take(pa.array(order))

    return shuffled


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` as ``row``, with ``_shard, _bucket, _place`` (from 0 in the bucket).

    The number of buckets follows the bytes of all texts.  Records of equal ``doc_id`` go to
    one shard, but spread over its buckets by text and by their place in the input.
    """
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        shard_of(F.col("doc_id"), shards, seed).alias("_shard"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_tie"), F.xxhash64(text, F.lit(seed)).alias("_text"),
        F.monotonically_increasing_id().alias("_at"),
    )
    scattered = rows.select(
        "row", "_shard", F.pmod(F.xxhash64("_tie", "_text", F.col("_at")), F.lit(buckets)).cast("int").alias("_bucket"),
        "_tie", "_text",
    )
    kept = scattered.drop("_tie", "_text").schema.add("_place", "long", True)
    return scattered.groupBy("_shard", "_bucket").applyInArrow(_fisher_yates(seed), kept)


def written(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards as Parquet, a folder each, and read them back as ``row, _shard, slot``.

    ``slot`` counts without gaps from 0 in each shard: buckets one after the other, each in
    its shuffled order.  An empty table writes nothing and gives an empty one.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/farfield/shards-{uuid.uuid4().hex}"
    out = shuffled(docs, **options)
    out.write.partitionBy("_shard").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    sizes = stage(back.groupBy("_shard", "_bucket").agg(F.count("*").alias("n")), "bucket-sizes")
    order = W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    begun = sizes.select("_shard", "_bucket", (F.sum("n").over(order) - F.col("n")).alias("begin"))
    return back.join(begun, ["_shard", "_bucket"]).select(
        "row", "_shard", (F.col("begin") + F.col("_place")).alias("slot")
    )
