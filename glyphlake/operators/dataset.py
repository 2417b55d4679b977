"""Dataset preparation: charset, labels, reproducible splits, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.operators.quantiles import exact, refined, sketches

PARTS = ("train", "valid", "test")
#: Hexadecimal digits of a hash whose prefixes part a class.
PREFIX = 3


def seeded(key: Column, seed: int | None = None) -> Column:
    """The MD5 of a key, or of a seed and the key; the same on every engine."""
    key = key.cast("string")
    return F.md5(key if seed is None else F.concat(F.lit(f"{seed}:"), key))


def bucket(key: Column, seed: int | None = None) -> Column:
    """0 to 99 from the hash of a key."""
    return F.pmod(F.conv(F.substring(seeded(key, seed), 1, 15), 16, 10).cast("long"), F.lit(100))


def split(df: DataFrame, key: str, weights: tuple[int, int, int] = (80, 10, 10), stratify: str | None = None, seed: int | None = None, exact: bool = False) -> DataFrame:
    """``df`` with ``split``: by the hash of the key and a seed, or by rank of the hash, so that the parts have the sizes that the weights say.

    Ranks are counted inside each class of ``stratify``, so that each class is cut alike, or over all rows if ``exact``.
    """
    if stratify is None and not exact:
        at = bucket(F.col(key), seed)
        return df.withColumn("split", _part(at, weights))
    # Ranks are counted inside prefixes of the hash and along them, so that no task sees a whole class.
    of = [stratify] if stratify else []
    df = df.withColumn("__md5", seeded(F.col(key), seed)).withColumn("__prefix", F.substring("__md5", 1, PREFIX))
    counts = df.groupBy(*of, "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*of).orderBy("__prefix")  # without a class, over the prefixes alone: 16 ** PREFIX rows
    before = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias("__class") for c in of], F.col("__prefix").alias("__p"), before.alias("__before"), F.sum("__n").over(Window.partitionBy(*of)).alias("__total"))
    same = F.col("__prefix").eqNullSafe(F.col("__p"))
    df = df.join(counts.hint("merge"), same & F.col(stratify).eqNullSafe(F.col("__class")) if stratify else same)
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*of, "__prefix").orderBy("__md5", key)) - 1
    df = df.withColumn("__at", F.floor(place * 100 / F.col("__total"))).drop("__md5", "__prefix", "__class", "__p", "__before", "__total")
    return df.withColumn("split", _part(F.col("__at"), weights)).drop("__at")


def _part(at: Column, weights: tuple[int, int, int]) -> Column:
    return F.when(at < weights[0], PARTS[0]).when(at < weights[0] + weights[1], PARTS[1]).otherwise(PARTS[2])


def check_split(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of one split that the other puts elsewhere or lacks: (missing, moved), both 0 if splits agree."""
    both = a.select(key, F.col("split").alias("sa")).join(b.select(key, F.col("split").alias("sb")), key, "full")
    return both.agg(F.count_if(F.col("sa").isNull() | F.col("sb").isNull()).alias("missing"), F.count_if(F.col("sa") != F.col("sb")).alias("moved"))


def for_augmentation(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def build_charset(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in order with a stable index; the blank comes last."""
    labels = df.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    indexed = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("idx"))  # one row a class
    return indexed.unionByName(labels.agg(F.lit("<blank>").alias("label"), F.count(F.lit(1)).cast("int").alias("idx")))


def known_labels(df: DataFrame, charset: DataFrame, label: str = "label") -> DataFrame:
    return df.join(charset.select(F.col("label").alias(label)), label, "left_semi")


def unknown_labels(df: DataFrame, charset: DataFrame, label: str = "label") -> DataFrame:
    return df.join(charset.select(F.col("label").alias(label)), label, "left_anti")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each class, and whether all classes have as many."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("balanced", F.min("n").over(Window.partitionBy()) == F.max("n").over(Window.partitionBy()))


SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def size_distribution(df: DataFrame, column: str, by: str, small: bool = False) -> DataFrame:
    """Per group: smallest, largest and mean size, and the sizes below which half, 90 and 99 hundredths of the rows lie.

    The last ones are exact values of rows, found through sketches; ``small`` holds a group's sizes in memory for interpolated values.
    A group without sizes has nulls.
    """
    whole = df.groupBy(by).agg(F.min(column).alias("smallest"), F.max(column).alias("largest"), F.avg(column).alias("mean"), *(exact(column, SHARES) if small else []))
    if small:
        return whole
    parts = refined(df, [by], column, SHARES, sketches(df, [by], column)).drop("n").withColumnRenamed(by, "__by")
    return whole.join(parts.hint("merge"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
