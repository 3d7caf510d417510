"""Quality of labels, scores and approximate neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farfield.functions.text import run_parameters
from farfield.session import stage


def compare_labels(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``key, expected, actual`` for the keys both sides have."""
    return expected.select("key", F.col("label").alias("expected")).join(
        actual.select("key", F.col("label").alias("actual")), "key"
    )


def running_totals(rows: DataFrame, order: list, totals: list[str]) -> DataFrame:
    """Add ``before_<c>``: the sum of each column over all rows ordered earlier.

    A distributed prefix sum: rows are range-partitioned by the order, summed inside
    their range, and shifted by the totals of the ranges before; only one total per
    range is brought together.
    """
    spread = stage(
        rows.repartitionByRange(*order).withColumn("span", F.spark_partition_id()), "ordered"
    )
    ahead = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spans = spread.groupBy("span").agg(*(F.sum(c).alias(f"sum_{c}") for c in totals))
    offsets = spans.select(
        "span", *(F.coalesce(F.sum(f"sum_{c}").over(ahead), F.lit(0)).alias(f"ahead_{c}") for c in totals)
    )
    summed = spread.select(
        "*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"inside_{c}") for c in totals)
    ).join(F.broadcast(offsets), "span")  # one row per range partition
    return summed.select(
        *rows.columns, *((F.col(f"ahead_{c}") + F.col(f"inside_{c}")).alias(f"before_{c}") for c in totals)
    )


def _steps(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per run and distinct score, from the highest: positives, negatives, and those before."""
    counted = scored.groupBy(*by, "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    order = [*by, F.desc("score")]
    steps = running_totals(counted, order, ["pos", "neg"])
    if not by:
        return steps
    base = steps.groupBy(*by).agg(F.min("before_pos").alias("bp"), F.min("before_neg").alias("bn"))
    return steps.join(base, by).select(
        *by, "score", "pos", "neg",
        (F.col("before_pos") - F.col("bp")).alias("before_pos"),
        (F.col("before_neg") - F.col("bn")).alias("before_neg"),
    )


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve of ``score`` against the 0/1 ``label``, per run if ``by``.

    The chance that a positive outscores a negative, ties counting half; null when a
    run has only one class.
    """
    by = by or []
    wins = F.col("neg").cast("double") * (F.col("before_pos") + F.col("pos") / 2)
    totals = _steps(scored, by).groupBy(*by).agg(
        F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n"))
    return totals.select(*by, area.alias("auc"))


def roc_curve(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC points ``score, fpr, tpr``, one per distinct score, plus the origin (null score)."""
    by = by or []
    steps = _steps(scored, by).select(
        *by, "score",
        (F.col("before_pos") + F.col("pos")).alias("tp"),
        (F.col("before_neg") + F.col("neg")).alias("fp"),
    )
    ends = steps.groupBy(*by).agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    if by:
        joined = steps.join(ends, by)
    else:
        total = ends.first()
        joined = steps.withColumn("p", F.lit(total["p"])).withColumn("n", F.lit(total["n"]))
    points = joined.select(
        *by, "score",
        F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("tpr"),
    )
    origin = ends.select(
        *by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.withColumn("score", F.col("score").cast("double")).unionByName(origin)


def sweep(scored: DataFrame, run: str) -> DataFrame:
    """AUC of every run and which run is best (the smallest among equals)."""
    areas = stage(roc_auc(scored, [run]), "areas")
    best = areas.orderBy(F.desc("auc"), run).first()
    return areas.withColumn("chosen", F.col(run) == F.lit(best[run] if best else None))


def with_run_parameters(results: DataFrame, name: str = "run") -> DataFrame:
    """Add the parameters coded in the run name."""
    return results.select("*", *(c.alias(n) for n, c in run_parameters(F.col(name)).items()))


def neighbour_quality(
    approximate: DataFrame, exact: DataFrame, touched: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """How well approximate neighbour lists reproduce exact ones; one row, or one for each ``by``.

    A query counts as correct when both lists agree at every place of the shorter one.
    ``touched`` is the number of candidate pairs examined.
    """
    ids = lambda lists: F.transform(lists, lambda e: e["j"])
    none = F.array().cast("array<bigint>")
    both = approximate.select(*by, "i", ids("nbrs").alias("a")).join(
        exact.select(*by, "i", ids("nbrs").alias("e")), [*by, "i"], "full_outer"
    )
    both = both.select(*by, F.coalesce("a", none).alias("a"), F.coalesce("e", none).alias("e"))
    shared = F.size(F.array_intersect("a", "e"))
    short = F.least(F.size("a"), F.size("e"))
    agree = F.slice("a", F.lit(1), short) == F.slice("e", F.lit(1), short)
    sums = both.groupBy(*by).agg(
        F.count("*").alias("queries"),
        F.sum(shared).alias("tp"),
        F.sum(F.size("a") - shared).alias("fp"),
        F.sum(F.size("e") - shared).alias("fn"),
        F.sum(agree.cast("int")).alias("correct"),
    )
    share = lambda part, whole: F.try_divide(F.col(part) * F.lit(100.0), whole)
    rated = sums.select(
        *by, "queries", "tp", "fp", "fn",
        share("tp", F.col("tp") + F.col("fp")).alias("precision"),
        share("tp", F.col("tp") + F.col("fn")).alias("recall"),
        share("correct", F.col("queries")).alias("correct_pct"),
    )
    if touched is None:
        return rated
    everything = F.col("queries").cast("double") * F.col("queries")
    return rated.withColumn("touched_pct", F.try_divide(F.lit(touched * 100.0), everything))
