"""Tables of the library: schemas, readers and sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.sources.folders import paths_below, read_folder

KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def schema(ddl: str) -> T.StructType:
    """A flat schema from ``name type`` pairs; needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (pair.split() for pair in ddl.split(","))])


RECOGNITIONS = schema(
    "id bigint, document_id bigint, user_id bigint, model_used string, model_simulated boolean, text string, confidence double, processing_time_ms double, "
    "file_name string, file_type string, thumbnail string, num_chars int, num_lines int, status string, created_at timestamp_ntz"
)
DOCUMENTS = schema("id bigint, original_filename string, saved_path string, uploaded_at timestamp_ntz")
USERS = schema("id bigint, full_name string, email string, password_hash string, university string, role string, avatar_url string, created_at timestamp_ntz")
LINE_BOXES = schema("page_id bigint, line_no int, text string, x int, y int, w int, h int")
#: Unknown labels that a warning names.
NAMED = 20
#: Lines of a bucket of a text layer.
LAYER_ROWS = 2_000_000
#: The models that the library knows (fixed values).
MODELS = (("crnn", "CRNN"), ("transformer", "Transformer OCR"))


def read_recognitions(spark: SparkSession, path: str) -> DataFrame:
    """Recognitions without the column of their layout by day, if they have one."""
    return spark.read.schema(RECOGNITIONS).parquet(path).select([f.name for f in RECOGNITIONS])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users without their password hashes: that column is never read."""
    return spark.read.schema(T.StructType([f for f in USERS.fields if f.name != "password_hash"])).parquet(path)


def read_uploads(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Files as rows: name, path, bytes, size, time; with ``deep`` those in folders of ``path`` too, as ``write_files`` spreads them."""
    return read_folder(spark, path, deep).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("uploaded_at"))


def read_class_dirs(spark: SparkSession, root: str, charset: DataFrame | None = None) -> DataFrame:
    """PNG files below ``root``, labelled by their folder; labels outside ``charset`` are left out, and named in a warning."""
    label = F.element_at(F.split("path", "/"), -2).alias("label")
    rows = read_folder(spark, root, True, ".png").select(label, F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")
    if charset is None:
        return rows
    unknown = [r["label"] for r in paths_below(spark, root, ".png").select(label).distinct().join(charset.select("label"), "label", "left_anti").orderBy("label").limit(NAMED).collect()]
    if unknown:
        warnings.warn(f"labels outside the charset are left out: {', '.join(unknown)}", stacklevel=2)
    return rows.join(charset.select("label"), "label", "left_semi")


def models_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "model_id string, name string")


def write_recognitions(df: DataFrame, path: str) -> None:
    """Append rows, laid out by day and sorted by user, so that a user's page reads few row groups; a day of many rows is cut by user."""
    df.withColumn("day", F.to_date("created_at")).repartitionByRange("day", "user_id").sortWithinPartitions("day", "user_id").write.mode("append").partitionBy("day").parquet(path)


def write_text(df: DataFrame, path: str, column: str = "text", bom: bool = False) -> None:
    """One text file per partition, UTF-8; with ``bom`` each text begins with a byte order mark."""
    text = F.concat(F.lit("\ufeff"), F.col(column)) if bom else F.col(column)
    df.select(text.alias("value")).write.text(path)


def write_cells(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").parquet(path)


def write_text_layer(layer: DataFrame, path: str, by: str = "page_id", buckets: int | None = None) -> None:
    """Lines with their geometry; a document's lines lie in one bucket, in order. There are as many buckets as the rows need, unless given."""
    buckets = buckets or max(8, layer.count() // LAYER_ROWS)
    layer.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", by, "place").write.mode("overwrite").partitionBy("bucket").parquet(path)
