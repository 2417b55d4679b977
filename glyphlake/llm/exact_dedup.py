"""Exact dedup: 128-bit content hashes, byte comparison inside a hash group, one row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, fresh, stored, text_of


def md5_bits(c: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(c))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=md5_bits) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays.
    Grouping is by (hash, text), so Spark compares the bytes inside each hash group and
    collapses copies before the shuffle; a group of any size moves as one row a task. Should two texts
    share a hash, rows of that hash are matched by their text.

    Texts of any length are compared whole. Null text counts as empty, null ids never win against others (a group with null ids only has
    ``keep_id`` null, ``kept`` true). Rows that repeat id and text are all ``kept``;
    :func:`drop_copies` leaves one. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("norm")).withColumn("h", digest(F.col("norm")))
    texts = rows.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(texts.select("h", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")), "groups")
    shared = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    slim = rows.select("doc_id", "h")
    if shared.isEmpty():
        found = slim.join(groups.hint("merge"), "h")
    else:
        shared = stored(shared, "shared")
        apart = rows.join(shared.hint("merge"), "h", "left_semi")
        exact = apart.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first(F.sha2("norm", 256)).alias("text_sha256"))
        found = slim.join(shared.hint("merge"), "h", "left_anti").join(groups.hint("merge"), "h").drop("h").unionByName(apart.join(exact.hint("merge"), ["h", "norm"]).drop("h", "norm"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=md5_bits) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id; all columns stay.

    One grouping by (hash, text) compares the bytes and carries the winning row, so a group of any size
    moves as one row a task. Null texts count as empty; null ids lose against others; of rows that repeat one stays. Texts of any
    length are whole; an empty table gives an empty result.
    """
    h, norm, row, rank = (fresh(x) for x in ("h", "norm", "row", "rank"))
    rank_of = F.struct(F.col(id_col).isNotNull().alias("there"), F.col(id_col).alias("id"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), ascii_lower(text_of(text_col)).alias(norm), rank_of.alias(rank)).withColumn(h, digest(F.col(norm)))
    return rows.groupBy(h, norm).agg(F.max_by(row, rank).alias(row)).select(f"{row}.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
"""
