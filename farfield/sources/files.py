"""Point files: readers for each layout, file-order numbering, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farfield.functions import text as T
from farfield.session import stage


BROADCAST_BLOCKS = 100_000  # a row of some 200 bytes each


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file block they come from."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def in_file_order(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the 0-based place of each row in file order.

    ``rows`` is ``lines`` through filters and projections only.  A scan reads a block's lines
    one after the other, so running ids give the place inside it; blocks are shifted by the
    rows of those before.  Only a first id and a count per block are brought together, and
    no line is shuffled while blocks are few enough to broadcast those.
    """
    split = ["file", "block"]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    counts = numbered.groupBy(*split).agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = F.sum("rows").over(Window.orderBy(*split)) - F.col("rows")
    shifts = stage(counts.select(*split, (before - F.col("first")).alias("shift")), "block-shifts")
    if shifts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        shifts = F.broadcast(shifts)
    placed = numbered.join(shifts, split)
    return placed.withColumn("pos", F.col("row") + F.col("shift")).drop(*split, "row", "shift")


def keyed_points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """``key x1..xd [label]`` lines: ``pos, key, value, x, label``.

    ``value`` is the record a stream carries: the features, a blank after each.
    """
    parts = in_file_order(lines(spark, path).filter(F.trim("value") != "")).withColumn(
        "w", T.words(F.col("value"))
    )
    features = T.feature_words(F.col("w"), dims)
    return parts.select(
        "pos",
        F.col("w")[0].alias("key"),
        F.concat(F.array_join(features, " "), F.lit(" ")).alias("value"),
        T.numbers_or_hashes(F.transform(features, F.lower)).alias("x"),
        T.label_word(F.col("w"), dims).try_cast("int").alias("label"),
    )


def assign_keys(spark: SparkSession, path: str) -> DataFrame:
    """Prefix each line with a running key from 1, dropping its second-last column."""
    numbered = in_file_order(lines(spark, path)).withColumn("key", F.col("pos") + 1)
    kept = T.without_second_last(T.words(F.col("value")))
    return numbered.select("key", F.concat_ws(" ", F.col("key"), F.array_join(kept, " ")).alias("line"))


def classed_points(spark: SparkSession, path: str) -> DataFrame:
    """``x y class`` lines."""
    return spark.read.csv(path, sep=" ", schema="x double, y double, class string")


def vector_lines(
    spark: SparkSession, path: str, max_rows: int | None = None, expected_columns: int | None = None
) -> DataFrame:
    """Vector lines with an optional key: ``pos, key, x``.

    Lines carry keys if the first word of the first line is not a number.
    """
    opening = in_file_order(lines(spark, path)).filter("pos = 0").first()
    starts_with = spark.createDataFrame([(opening["value"] if opening else "0",)], "value string")
    keyed = starts_with.select(F.split("value", " ")[0].try_cast("double").isNull()).first()[0]
    parts = in_file_order(lines(spark, path)).withColumn("w", T.blank_separated(F.col("value")))
    if max_rows is not None:
        parts = parts.filter(F.col("pos") < max_rows)
    cells = F.col("w")
    if expected_columns is not None:
        complaint = F.concat(F.lit("unexpected row length in line "), F.col("pos") + 1)
        cells = F.when(F.size("w") == expected_columns, cells).otherwise(
            F.raise_error(complaint).cast("array<string>")
        )
    key = cells[0] if keyed else F.lit(None).cast("string")
    numbers = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))) if keyed else cells
    return parts.select("pos", key.alias("key"), numbers.cast("array<double>").alias("x"))


def column_where(table: DataFrame, column: str | int, accept: Column | None = None) -> DataFrame:
    """One column of the rows an optional predicate accepts."""
    name = table.columns[column] if isinstance(column, int) else column
    return (table if accept is None else table.filter(accept)).select(name)


def classed_records(spark: SparkSession, path: str, features: int = 41) -> DataFrame:
    """Comma-separated features and class: rows of the kept classes, relabelled 0/1 and keyed."""
    parts = lines(spark, path).withColumn(
        "w", F.split(F.regexp_replace("value", r"^[.]+|[.]+$", ""), ",")
    )
    parts = parts.withColumn("label", T.class_label(F.col("w")[features])).filter("label is not null")
    numbered = in_file_order(parts).withColumn("key", F.col("pos") + 1)
    record = F.concat_ws(" ", F.col("key"), F.array_join(F.slice("w", 1, features), " "), F.col("label"))
    return numbered.select("key", "label", record.alias("line"))


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def read_labels(spark: SparkSession, path: str, sink: bool = False) -> DataFrame:
    """Labels by key; the last line of a key wins.

    Result files carry ``<origin> key, label``; data files start with the key and end
    with the label.
    """
    parts = in_file_order(lines(spark, path).filter(F.trim("value") != "")).withColumn(
        "w", T.words(F.col("value"))
    )
    key = F.regexp_replace(F.col("w")[1], "^,+|,+$", "") if sink else F.col("w")[0]
    label = F.element_at("w", -1).cast("int")
    return parts.select(key.alias("key"), label.alias("label"), "pos").groupBy("key").agg(
        F.max_by("label", "pos").alias("label")
    )


def expected_outliers(spark: SparkSession, path: str) -> DataFrame:
    return classed_points(spark, path).select("x", "y").distinct()


def expected_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``_ x y _ key=lof`` lines."""
    w = F.split("value", " ")
    return spark.read.text(path).select(
        w[1].cast("double").alias("x"),
        w[2].cast("double").alias("y"),
        F.split(w[4], "=")[1].cast("double").alias("lof"),
    )


def write_profiles(scored: DataFrame, path: str, dims: int, columns: list[str] | None = None) -> None:
    """Scores as CSV with a header, one column per coordinate."""
    coordinates = [F.col("x")[j].alias(f"x{j + 1}") for j in range(dims)]
    scored.select(*coordinates, *(columns or ["n", "kd", "lrd", "lof"])).write.option(
        "header", True
    ).csv(path)


def append_lines(labelled: DataFrame, path: str, column: str = "line") -> None:
    labelled.select(column).write.mode("append").text(path)
