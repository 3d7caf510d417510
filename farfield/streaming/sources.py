"""Streams of keyed point records, and replay of a table as one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.functions.text import parse_point
from farfield.session import scratch_dir

RECORD = "key string, value string, seq bigint"


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """``key, value, seq`` records of a Kafka topic; needs the Kafka connector.

    ``seq`` is the offset: order within a topic of one partition, which is what a
    strictly ordered stream needs.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return raw.select(
        F.col("key").cast("string"), F.col("value").cast("string"), F.col("offset").alias("seq")
    )


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same records from parquet files, oldest first.

    A file may be one task's to read, whatever its size; what is done with its records is shared.
    """
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.select("key", "value", "seq").repartition(spark.sparkContext.defaultParallelism)


def parsed(records: DataFrame, dims: int) -> DataFrame:
    """Records to points: ``key, seq, x``."""
    return records.select("key", "seq", parse_point(F.col("value"), dims).alias("x"))


def publish(records: DataFrame, servers: str, topic: str) -> None:
    """Send ``key, value`` records to a Kafka topic; needs the Kafka connector."""
    records.select("key", "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("topic", topic).save()


def replay(records: DataFrame, batches: int, path: str | None = None) -> str:
    """Write ``key, value, seq`` as ordered files, one per future micro-batch.

    Stands in for a paced producer: the pace becomes the trigger of the reading query.  One
    write for all batches; a batch is one file, as it will be one micro-batch, and the files'
    times put them in order.
    """
    spark = records.sparkSession
    path = path or f"{scratch_dir(spark)}/farfield/replay-{uuid.uuid4().hex}"
    bounds = records.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    low, high = bounds["lo"] or 0, bounds["hi"] or 0
    step = max(1, -(-(high - low + 1) // batches))
    number = F.floor((F.col("seq") - low) / step).cast("int").alias("batch")
    # a batch goes to one task, whatever else that task gets
    spread = records.select("key", "value", "seq", number).repartition(batches, "batch")
    spread.write.partitionBy("batch").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted(
        (f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")),
        key=lambda folder: int(folder.getName()[6:]),
    )
    now = fs.getFileStatus(root).getModificationTime()
    for place, folder in enumerate(folders):
        for file in fs.listStatus(folder):
            fs.setTimes(file.getPath(), now - 1000 * (len(folders) - place), -1)
    return path
