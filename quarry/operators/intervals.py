"""Sets of sequence numbers as disjoint intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Intervals never cross a multiple of this, so every step works on one stretch of numbers at a time.
STRETCH = 1 << 20


def stretch(number: Column) -> Column:
    return F.floor(number / F.lit(STRETCH)).cast("long")


def to_intervals(numbers: DataFrame, column: str) -> DataFrame:
    """``stretch, low, high``: the disjoint intervals that hold exactly the numbers; nulls and repeats count for nothing."""
    each = numbers.filter(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("n")).distinct().withColumn("stretch", stretch(F.col("n")))
    run = F.col("n") - F.row_number().over(W.partitionBy("stretch").orderBy("n"))
    return each.withColumn("run", run).groupBy("stretch", "run").agg(F.min("n").alias("low"), F.max("n").alias("high")).select("stretch", "low", "high")


def merge(intervals: DataFrame) -> DataFrame:
    """Overlapping and adjacent intervals of a stretch become one."""
    order = W.partitionBy("stretch").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("low") > before + 1), 1).otherwise(0)
    numbered = intervals.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("stretch", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("stretch", "low", "high")


def subtract(rows: DataFrame, column: str, intervals: DataFrame) -> DataFrame:
    """The rows whose number lies in no interval; rows without a number are dropped."""
    inside = (stretch(F.col(f"r.{column}")) == F.col("i.stretch")) & F.col(f"r.{column}").between(F.col("i.low"), F.col("i.high"))
    return rows.filter(F.col(column).isNotNull()).alias("r").join(intervals.alias("i"), inside, "left_anti")


def keep(rows: DataFrame, column: str, intervals: DataFrame) -> DataFrame:
    """The rows whose number lies in some interval."""
    inside = (stretch(F.col(f"r.{column}")) == F.col("i.stretch")) & F.col(f"r.{column}").between(F.col("i.low"), F.col("i.high"))
    return rows.alias("r").join(intervals.alias("i"), inside, "left_semi")
