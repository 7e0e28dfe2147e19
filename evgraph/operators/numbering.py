"""Row numbers in a total order without a window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.session import few, stored


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds name: 1, 2, ... in the given order within each value of `by` (one numbering if by is empty).

    Rows are dealt out by ranges of (by, order), sorted and counted as they are written; a prefix sum over the ranges, one row per value and range, adds what
    lies before. So a value that holds most rows is spread over many tasks, and rows move once. Nulls come first and count as a value; equal rows get any
    order of their numbers.
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")  # consecutive within a task
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    counts = counts.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], (before + 1 - F.col("__first")).alias("__shift"))
    same: list[Column] = [F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)]]
    met = ranged.join(few(counts, "numbered-before"), reduce(lambda a, b: a & b, same))
    return met.select(*rows.columns, (F.col("__id") + F.col("__shift")).alias(name))
