"""A trigram index over stored recognitions: which files may hold a search term; the exact test then reads those alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators.history import matches

COLUMNS = ("file_name", "text")
#: Files beyond which a list of them is no gain: the whole table is read then.
MOST_FILES = 20_000
GRAM = 3
#: Texts that a task turns into Python strings at once, and trigrams that it gathers of a file before they go on.
TEXTS, MOST_GRAMS = 64, 200_000


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; none for a shorter or null one."""
    return F.arrow_udf(_trigrams, "array<string>")(F.lower(F.coalesce(c, F.lit(""))))


def _grams(texts: list[str]) -> np.ndarray:
    """The distinct runs of three characters inside texts, each as a number of three code points of 21 bits."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    for back in (1, 2):
        inside[(ends - back)[ends >= back]] = False
    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    return np.unique(keys[inside[: len(keys)]])


def _spelt(keys: np.ndarray) -> list[str]:
    codes = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    return [codes[at : at + GRAM] for at in range(0, len(codes), GRAM)]


def _trigrams(texts: pa.Array) -> pa.Array:
    parts = [pa.array([_spelt(_grams([t])) for t in texts.slice(at, TEXTS).to_pylist()], pa.list_(pa.string())) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def postings(table: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``trigram, column, file``: each once for every file, so that the index grows with the files and not with the rows.

    A task tells each trigram of a file once for some thousands of texts, as most of them recur from text to text.
    """
    texts = table.select(F.col("_metadata.file_path").alias("file"), *[F.lower(F.col(c).cast("string")).alias(c) for c in columns])
    return texts.mapInArrow(_gathered, "file string, column string, trigram string").distinct()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column(0)
        for name, texts in zip(batch.schema.names[1:], batch.columns[1:], strict=True):
            found: dict[str, np.ndarray] = {}
            for at in range(0, len(batch), TEXTS):
                own: dict[str, list[str]] = {}
                for file, t in zip(files.slice(at, TEXTS).to_pylist(), texts.slice(at, TEXTS).to_pylist(), strict=True):
                    own.setdefault(file, []).append(t or "")
                for file, some in own.items():
                    grams = np.union1d(found.get(file, np.empty(0, np.int64)), _grams(some))
                    if len(grams) > MOST_GRAMS:
                        yield _postings(file, name, grams)
                        grams = np.empty(0, np.int64)
                    found[file] = grams
            for file, grams in found.items():
                yield _postings(file, name, grams)


def _postings(file: str, column: str, grams: np.ndarray) -> pa.RecordBatch:
    same = [pa.array([x], pa.string()).take(pa.array([0] * len(grams), pa.int32())) for x in (file, column)]
    return pa.RecordBatch.from_arrays([*same, pa.array(_spelt(grams), pa.string())], ["file", "column", "trigram"])


def write_index(spark: SparkSession, path: str, index: str, columns: tuple[str, ...] = COLUMNS) -> int:
    """Add the files of the table at ``path`` that ``index`` does not know; how many there were.

    Postings are sorted by trigram, so a look-up reads the row groups of its trigrams; the files that are known lie beside them. They
    are written last: after a failure in between, the same files are indexed again, and their postings stand twice, to no harm.
    """
    table = spark.read.parquet(path)
    known = known_files(spark, index)
    new = [f for f in table.inputFiles() if _plain(f) not in known]
    if new:
        rows = spark.read.schema(table.schema).option("basePath", path).parquet(*new)
        postings(rows, columns).repartitionByRange("trigram", "file").sortWithinPartitions("trigram", "file").write.mode("append").parquet(f"{index}/postings")
        spark.createDataFrame([(f,) for f in new], "file string").write.mode("append").parquet(f"{index}/files")
    return len(new)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _plain(file: str) -> str:
    """A file's name in one spelling: Spark's columns and listings differ in the slashes behind ``file:`` and in escapes."""
    return re.sub("^file:/+", "file:///", unquote(file))


def known_files(spark: SparkSession, index: str) -> set[str]:
    """The files that an index knows: names alone, of which Spark's driver holds those of the table as well."""
    return {_plain(r["file"]) for r in _read(spark, f"{index}/files", "file string").collect()}


def grams_of(spark: SparkSession, term: str, literal: bool = False) -> list[str]:
    """Trigrams that a text must hold if it matches a term: those of its parts between wildcards."""
    parts = [term.strip().lower()] if literal else re.split("[%_]", term.strip())
    return sorted(spark.range(1).select(F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(p)) for p in parts])))).first()[0])


def candidate_files(spark: SparkSession, index: str, term: str, literal: bool = False) -> list[str] | None:
    """Files that hold all trigrams of the term in one column; None if the term has none or they are too many."""
    grams = grams_of(spark, term, literal)
    if not grams:
        return None
    held = _read(spark, f"{index}/postings", "file string, column string, trigram string").where(F.col("trigram").isin(grams))
    full = held.groupBy("file", "column").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams))
    found = [r["file"] for r in full.select("file").distinct().limit(MOST_FILES + 1).collect()]
    return None if len(found) > MOST_FILES else sorted(found)


def indexed_search(spark: SparkSession, path: str, index: str, term: str, literal: bool = False) -> tuple[DataFrame, int | None]:
    """(rows of the table that match, files read): the rows that ``matches`` finds; None if the whole table is read.

    Terms without three letters in a row have no trigram and read the whole table. Files that were added after the index was written
    are read as well.
    """
    table = spark.read.parquet(path)
    found = candidate_files(spark, index, term, literal) if term.strip() else None
    if found is None:
        return table.where(matches(term, literal)), None
    found, known = set(map(_plain, found)), known_files(spark, index)
    # Of the files that are there now: those found, and those that came after the index.
    files = [f for f in table.inputFiles() if _plain(f) in found or _plain(f) not in known]
    rows = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.limit(0)
    return rows.where(matches(term, literal)), len(files)
