"""What the corpus operators share: words, tables, and keeping rows whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.session import stage

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"

__all__ = ["BLANKS", "GAP", "packed", "stage", "table", "text_of", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column | str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a non-null text: its longest runs without white space, in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def packed(docs: DataFrame, *columns: Column, keep: list[str] | None = None) -> DataFrame:
    """``row`` (every column of ``docs``, or those of ``keep``) next to ``columns``.

    Names made on the way then never clash with the caller's; ``row.*`` gives them back.
    """
    kept = docs.columns if keep is None else keep
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *columns)
