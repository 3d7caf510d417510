"""Session set-up for tests and benchmarks, and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_passing: ContextVar[list | None] = ContextVar("passing", default=None)


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("farfield")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the session names.

    A machine-local folder is only ever chosen in local mode, where driver and
    executors share one disk, and then once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="farfield-")
    return _made[context.applicationId]


def stage(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once and read it back: survives lost executors, keeps column pruning.

    ``spark`` is the session to read with, if it is to be another than the frame's own.
    """
    path = f"{scratch_dir(spark or df.sparkSession)}/farfield/{name}-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are dropped at the end: what is to stay must be written elsewhere."""
    token = _passing.set(made := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for path in made:
            delete(spark, path)


@contextmanager
def lean(spark: SparkSession):
    """Nothing of what is done inside stays on disk: shuffle files go with the job that wrote them,
    staged tables at the end.  Frames made inside are to be evaluated inside."""
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, "false")
    spark.conf.set(conf, "true")
    try:
        with passing(spark):
            yield
    finally:
        spark.conf.set(conf, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Bound the rows per Arrow batch while rows are wide (one row = one block of points)."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(rows))
    try:
        yield
    finally:
        spark.conf.set(conf, before)
