"""Deletes and patches of stored recognitions: days that hold a row to change are rewritten, all others are left alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.sources.shared import remove

#: The column of the layout, as in ``write_recognitions``; rows without a date lie under Hive's name for null.
DAY, NO_DAY = "day", "__HIVE_DEFAULT_PARTITION__"
#: Whether a row is a mark beside the stored rows, and what goes before a column that it brings.
MARK, PUT = "mark__", "__"


def _rewrite(spark: SparkSession, path: str, marks: Callable[[DataFrame], DataFrame], values: list[str] | None = None, key: str = "id") -> list[str]:
    """Rewrite the days of rows that ``marks`` leaves of the table; the names of these days.

    ``marks`` gives rows to delete or, with ``values``, rows and the non-null values of these columns to put over theirs. Of marked rows
    only keys are joined; they are dealt out by day and user beside the stored rows, so that whole rows are shuffled once, into the
    order in which they lie. Spark reads all old rows before it replaces whole days at the end of the job (dynamic overwrite), and a
    day left without rows is removed. If it fails in between, some days are old and others new, each whole, and a second call does the
    rest: days that need nothing more are not touched.
    """
    table = spark.read.parquet(path)
    if DAY not in table.columns:
        raise ValueError(f"{path} is not laid out by {DAY}")
    days = [r[DAY] for r in marks(table).select(DAY).distinct().collect()]  # a row a day
    if not days:
        return []
    known = [d for d in days if d is not None]
    touched = F.col(DAY).isin(known) if known else F.lit(False)
    old = table.where(touched | F.col(DAY).isNull()) if None in days else table.where(touched)
    order = [c for c in ("user_id",) if c in table.columns]
    put = [f"{PUT}{c}" for c in values or []]
    row = [DAY, *order, *[c for c in dict.fromkeys(("id", key)) if c in table.columns and c not in order]]  # few rows share these, so a window holds few

    def changed(columns: list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
        marked = marks(old).select(*row, *put).distinct().withColumn(MARK, F.lit(True))
        both = place(old.select(*columns).withColumn(MARK, F.lit(False)).unionByName(marked, allowMissingColumns=True))
        at = Window.partitionBy(*row)
        if values is None:
            return both.withColumn(MARK, F.max(MARK).over(at)).where(~F.col(MARK)).drop(MARK)
        return both.select("*", *[F.first(c, ignorenulls=True).over(at).alias(f"{PUT}{c}") for c in put]).where(~F.col(MARK)).drop(MARK)

    left = {r[DAY] for r in changed(row, lambda rows: rows).select(DAY).distinct().collect()} if values is None else set(days)
    rows = changed(table.columns, lambda rows: rows.repartitionByRange(DAY, *order))
    if values is not None:
        rows = rows.select(*[F.coalesce(f"{PUT}{PUT}{c}", c).alias(c) if c in values else F.col(c) for c in table.columns])
        if set(order) & set(values):
            rows = rows.repartitionByRange(DAY, *order)
    rows.sortWithinPartitions(DAY, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    for day in (d for d in days if d not in left):
        remove(spark, f"{path}/{DAY}={NO_DAY if day is None else day}")
    return sorted(NO_DAY if d is None else str(d) for d in days)


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> list[str]:
    """Delete the rows named by (id, user_id) from the table at ``path``; another user's rows stay. The days that were rewritten."""
    wanted = ids.select("id", "user_id").distinct()
    return _rewrite(spark, path, lambda t: t.join(wanted.hint("merge"), ["id", "user_id"], "left_semi"))


def delete_stored_users(spark: SparkSession, path: str, users: DataFrame) -> list[str]:
    """Delete all rows of users."""
    wanted = users.select("user_id").distinct()
    return _rewrite(spark, path, lambda t: t.join(wanted.hint("merge"), "user_id", "left_semi"))


def patch_stored(spark: SparkSession, path: str, patches: DataFrame, key: str = "id") -> list[str]:
    """Put the non-null columns of ``patches`` (one row a key) over rows of the same key. A patch that changes nothing rewrites nothing.

    The date of a row is its place, so it cannot be patched.
    """
    if {DAY, "created_at"} & set(patches.columns):
        raise ValueError("the date of a row cannot be patched")
    changed = [c for c in patches.columns if c != key]
    over = patches.select(F.col(key), *[F.col(c).alias(f"{PUT}{c}") for c in changed])

    def marks(table: DataFrame) -> DataFrame:
        differs = F.lit(False)
        for c in changed:
            differs = differs | (F.col(f"{PUT}{c}").isNotNull() & ~F.col(f"{PUT}{c}").eqNullSafe(F.col(c)))
        return table.join(over.hint("merge"), key).where(differs)

    return _rewrite(spark, path, marks, changed, key)
