"""The tables behind the registered queries, as points, records and fixed parameters."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions import hashing
from farfield.session import scratch_dir

K = 5
TOP = 10
PLANES = np.round(hashing.uniform_planes(64, 4, 3, seed=11), 6)
GAUSSIAN = np.round(hashing.gaussian_planes(64, 5, 2, seed=12), 6)
FLAT_PLANES = np.round(hashing.uniform_planes(2, 6, 1, seed=13), 6)
# sides that tell customers apart although their coordinates differ in scale
STREAM_PLANES = np.round(hashing.uniform_planes(2, 24, 1, seed=15) * [0.01, 1.0], 6)
PROBES = np.round(hashing.uniform_planes(64, 12, 1, seed=21), 6)
PROJECTIONS = np.round(hashing.gaussian_planes(2, 2, 2, seed=14), 6)
OFFSETS = [[17, 71], [42, 5]]
SHIFTS = np.round(np.random.default_rng(15).random((2, 1, 2)) * 400.0, 3)
WIDTH = 400.0
BOX_LOW, BOX_HIGH = [10.0, 905.0], [30.0, 950.0]


GRID_L2, GRID_L1 = 2.0, 8.0  # bucket widths


def by_rule(tables: int, hashes: int, dims: int, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that SQL can make too: squares and multiples modulo a prime."""
    n = np.arange(tables * hashes * dims, dtype=np.int64)
    return ((n * n % 10007 * 7919 + n * 104729 + salt * 15485863) % 10007 / 10007).reshape(tables, hashes, dims)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(*columns: str):
    return F.array(*(F.col(c).cast("double") for c in columns))


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("i"), vector("c_acctbal", "c_nationkey").alias("x")
    )


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("i"), vector("s_acctbal", "s_nationkey").alias("x")
    )


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("i"), vector("p_size", "p_retailprice").alias("x")
    )


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x")
    )


def customer_records(spark, sf_dir):
    """Customers as stream records ``key, value, seq``."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"),
        F.concat_ws(" ", "c_acctbal", "c_nationkey", F.lit("")).alias("value"),
        F.col("c_custkey").alias("seq"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/farfield/{name}-{uuid.uuid4().hex}"


def written_lines(lines: DataFrame, order: str, name: str) -> str:
    """Write ``line`` as text files that, taken in name order, follow ``order``."""
    path = scratch(lines.sparkSession, name)
    lines.orderBy(order).select("line").write.text(path)
    return path
