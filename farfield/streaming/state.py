"""Versioned state of a stream: parquet segments named by a manifest per micro-batch.

A batch reads the manifest of the batch before it and writes its own last, so running a
batch again after a failure starts from the same state and overwrites its own output.
What only grows (labels, arrivals) is a log: a folder with one part per batch, in no manifest.
Once a batch is committed, segments that neither it nor the batch before it names are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.session import delete


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, batch_id: int) -> dict:
        """What batch ``batch_id`` left behind; empty before the first batch."""
        path = self._path("commits", f"{batch_id}.json")
        if batch_id < 0 or not self._fs(path).exists(path):
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(path.toString()).first()[0])

    def latest(self) -> int:
        """The last committed batch, -1 if none."""
        folder = self._path("commits")
        fs = self._fs(folder)
        if not fs.exists(folder):
            return -1
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def write(self, name: str, batch_id: int, rows: DataFrame, *folders: str) -> str:
        """Write a segment, with a folder per value of the columns ``folders``."""
        path = f"{self.root}/{name}/v{batch_id}"
        rows.write.mode("overwrite").parquet(path, partitionBy=list(folders))
        return path

    def commit(self, batch_id: int, manifest: dict) -> None:
        done, draft = self._path("commits", f"{batch_id}.json"), self._path("commits", f".{batch_id}.tmp")
        fs = self._fs(done)
        out = fs.create(draft, True)
        out.writeBytes(json.dumps(manifest))
        out.close()
        if fs.exists(done):
            fs.delete(done, False)
        fs.rename(draft, done)

    def log(self, name: str, batch_id: int, rows: DataFrame) -> None:
        """Set the part of a batch in the log ``name``."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def logged(self, name: str, schema: str, batch_id: int) -> DataFrame:
        """The log ``name`` up to a batch, with ``batch``."""
        folder = self._path(name)
        if not self._fs(folder).exists(folder):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}")
        return rows.filter(F.col("batch") <= batch_id)

    def collect_garbage(self, batch_id: int) -> None:
        """Delete what batches before the one before ``batch_id`` left and no later one names."""
        needed = self._named(self.manifest(batch_id)) | self._named(self.manifest(batch_id - 1))
        old = batch_id - 2
        while past := self.manifest(old):
            for path in self._named(past) - needed:
                delete(self.spark, path)
            delete(self.spark, self._path("commits", f"{old}.json").toString())
            old -= 1

    def _named(self, value) -> set[str]:
        """Every path of this state that a manifest names."""
        if isinstance(value, str):
            return {value} if value.startswith(f"{self.root}/") else set()
        parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return set().union(*map(self._named, parts))

    def read(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def newest(self, paths: list[str], schema, key: str = "i", only: Column | None = None) -> DataFrame:
        """Segments, oldest first, overlaid: the last segment that has a key decides.

        ``only`` restricts all of them to rows that have the same value of it in every segment.

        Segments after the first are as small as the batches that wrote them, so older
        rows are filtered by anti-joins on short key lists, not regrouped.
        """
        whole, seen = None, None
        for path in reversed(paths):
            part = self.spark.read.schema(schema).parquet(path)
            part = part if only is None else part.filter(only)
            if whole is None:
                whole, seen = part, part.select(key)
            else:
                older = part.join(seen, key, "left_anti").select(*part.columns)
                seen = seen.unionByName(part.select(key))
                whole = whole.unionByName(older)
        return whole if whole is not None else self.spark.createDataFrame([], schema)
