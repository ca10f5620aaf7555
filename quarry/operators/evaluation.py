"""Labelled evaluation of results (PR-16, AG-11, JN-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_hit(result: str = "r", label: str = "l") -> Column:
    """PR-16: whether a result is what a label asks for: its path, or one as good, and the line, page or second in it if given.

    ``result``: ``path, start_line, end_line, page, start_ms, end_ms``; ``label``: ``expected, also_correct, expected_line,
    expected_page, expected_seconds``. A place that the label names and the result lacks is a miss.
    """
    r, x = (lambda c: F.col(f"{result}.{c}")), (lambda c: F.col(f"{label}.{c}"))
    path = (r("path") == x("expected")) | F.coalesce(F.array_contains(x("also_correct"), r("path")), F.lit(False))
    line = x("expected_line").isNull() | x("expected_line").between(r("start_line"), r("end_line"))
    page = x("expected_page").isNull() | (x("expected_page") == r("page"))
    at = x("expected_seconds") * 1000
    second = x("expected_seconds").isNull() | ((at >= r("start_ms")) & (at <= r("end_ms")))
    return F.coalesce(path & line & page & second, F.lit(False))


def recall_at(results: DataFrame, labels: DataFrame, k: int = 1) -> DataFrame:
    """``queries, found, recall``: labels (by ``query_id``) of which one of the first ``k`` results (by ``place``) is a hit; one row."""
    first = results.filter(F.col("place") <= k).alias("r")
    each = labels.alias("l").join(first, F.col("l.query_id") == F.col("r.query_id"), "left").groupBy(F.col("l.query_id").alias("query_id")).agg(F.max(is_hit()).alias("hit"))
    counts = each.agg(F.count("*").alias("queries"), F.count_if("hit").alias("found"))
    return counts.withColumn("recall", F.when(F.col("queries") > 0, F.col("found") / F.col("queries")).otherwise(F.lit(0.0)))
