"""Ranks and slices of sorted rows without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.sources.shared import stored


def ranged(df: DataFrame, by: list[str], order: list[Column], name: str = "ranged") -> DataFrame:
    """``df`` sorted over all by ``by`` and ``order`` and written so, with ``__part`` (its range) and ``__at`` (rising without gaps inside it)."""
    keys = [*[F.col(c) for c in by], *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return stored(rows.withColumn("__part", F.shiftright("__at", 33)), name)


def runs_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a range and group of ``ranged`` rows: ``part, n, first`` and ``before``, the rows of the group in earlier ranges."""
    runs = rows.groupBy(F.col("__part").alias("part"), *by).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    along = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, not a row of the table
    return runs.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of ``order`` within ``by``. Rows that tie in all of it are numbered in any order.

    Ranks are counted inside sorted ranges and along them, so a group of any size is spread over tasks.
    """
    rows = ranged(df, by, order)
    runs = stored(runs_of(rows, by).select("part", *[F.col(c).alias(f"__own{i}") for i, c in enumerate(by)], (F.col("before") - F.col("first")).alias("shift")), "runs")
    same = F.col("__part") == F.col("part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__own{i}"))
    return rows.join(runs.hint("merge"), same).select(*df.columns, (F.col("__at") + F.col("shift") + 1).cast("long").alias(name))


def summed(df: DataFrame, by: list[str], order: list[Column], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` up to and with each row in the order of ``order`` within ``by``, counted as ``ranked`` counts."""
    rows = ranged(df, by, order)
    parts = rows.groupBy(F.col("__part").alias("part"), *by).agg(F.sum(weight).alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    runs = stored(parts.select("part", *[F.col(c).alias(f"__own{i}") for i, c in enumerate(by)], before.alias("before")), "runs")
    same = F.col("__part") == F.col("part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__own{i}"))
    inside = F.sum(weight).over(Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(runs.hint("merge"), same).select(*df.columns, (F.col("__inside") + F.col("before")).alias(name))
