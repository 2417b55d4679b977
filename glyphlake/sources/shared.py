"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may run without the setting, and gets a folder of its own."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and not again when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/glyphlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the table's own file system, if it is there."""
    system, place = place_of(spark, path)
    system.delete(place, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished folders ``name=<number>`` in ``path``, in order."""
    system, place = place_of(spark, path)
    if not system.exists(place):
        return []
    found = [x.getPath() for x in system.listStatus(place)]
    done = [x.getName().split("=")[1] for x in found if x.getName().startswith(f"{name}=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(map(int, done))
