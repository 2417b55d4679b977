"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.llm.common import stored, text_of

#: Ranges: enough that each holds about RANGE_ROWS rows, within these bounds (they bound what the driver sees).
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 5_000, 1_024, 8_192
#: Expected sampled keys a range; a bound on the sample, not on what is sharded.
SAMPLES_PER_RANGE = 16
#: A range is overfull beyond this many times its fair number of rows.
OVERFULL = 4


def _position(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= ``key``: a binary search inside the row."""
    if not bounds:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    padded = F.array(*[F.lit(b) for b in bounds])
    n = F.lit(len(bounds))

    def probe(at: Column, jump: Column) -> Column:
        to = at + jump
        return F.when((to <= n) & (F.get(padded, to - 1) <= key), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), probe)


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Rows are ordered by (text hash, id), so that copies lie side by side. Keys are drawn with a chance
    in proportion to size, their quantiles bound the ranges, and exact byte sums of the ranges tell
    where each shard begins: at the first row whose middle lies at or past its share of the bytes, so shards
    differ by less than the two largest documents. Ranges that hold too many rows are subdivided by a hash of the
    text, so that equal texts stay together; only a text that alone has more copies than a range may have rows is dealt by
    the hash of the id. A smaller group of equal texts is split only where a shard ends in it. Slots count rows of a shard in that order, from 0.

    Null text has size 1 and the CRC of the empty string; null ids sort first. Rows that repeat
    id and text may share a boundary in either order. Texts of any length count whole; extra columns are left out. An empty
    table gives an empty result.
    """
    text = text_of(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col(id_col), F.lit(1)).alias("sub"),
    )
    slim = stored(slim, "slim")
    n, total = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = min(MAX_RANGES, max(MIN_RANGES, n // RANGE_ROWS))
    # A row is drawn once at most; one larger than the drawing step is always drawn.
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    drawn = slim.where(F.pmod(F.xxhash64("sub", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * step < F.col("size"))
    at = [i / ranges for i in range(1, ranges)]
    bounds = drawn.agg(F.percentile_approx("key", at, 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    placed = slim.withColumn("part", _position(F.col("key"), bounds))
    counts = stored(placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "counts")
    fair = max(1, n // ranges)
    over = counts.where(F.col("rows") > OVERFULL * fair).select("part", F.ceil(F.col("rows") / fair).cast("int").alias("pieces"))
    # Overfull: split by the high bits of a hash, of the id for texts with too many copies, of the text for all others.
    wide = placed.join(F.broadcast(over), "part", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    hot = wide.where("pieces > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > OVERFULL * fair).select("key", F.lit(True).alias("hot"))
    hot = stored(hot, "hot")  # each has more rows than a range may, so there are fewer than ranges
    wide = wide.join(F.broadcast(hot), "key", "left")
    unit = F.shiftrightunsigned(F.when(F.col("hot"), F.col("sub")).otherwise(F.xxhash64("key", F.lit(2))), 33).cast("double") / F.lit(float(1 << 31))
    wide = stored(wide.withColumn("piece", F.least(F.floor(unit * F.col("pieces")).cast("int"), F.col("pieces") - 1)).drop("pieces", "hot"), "placed")
    sums = wide.groupBy("part", "piece").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    # At most a few times MAX_RANGES rows: each range and each piece of an overfull one.
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("part", "piece").orderBy("key", "sub", "doc_id", "text_crc32")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = wide.select("*", F.row_number().over(inside).alias("rn"), F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("own_before"))
    joined = ranked.join(F.broadcast(starts), ["part", "piece"]).select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.col("rn") - 1).alias("at_row"),
        F.least(F.floor((F.col("bytes_before") + F.col("own_before") + F.col("size") / 2) * shards / total).cast("int"), F.lit(shards - 1)).alias("shard"),
    )
    placed_rows = stored(joined, "ranked")
    first = placed_rows.groupBy("shard").agg(F.min("at_row").alias("first_row"))
    return placed_rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at_row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
