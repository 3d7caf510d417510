"""Choice of the stream algorithm by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from farfield.streaming.ilof import IncrementalLof
from farfield.streaming.rlof import WindowedLof

ALGORITHMS = {"ilof": IncrementalLof, "rlof": WindowedLof}


def detector(algorithm: str, spark: SparkSession, root: str, **parameters) -> IncrementalLof | WindowedLof:
    """The model that keeps its state under ``root``; call ``start`` on it with a stream."""
    chosen = ALGORITHMS.get(algorithm.lower())
    if chosen is None:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    return chosen(spark, root, **parameters)
