"""Many small files as rows: tasks list a folder that all executors share, name by name, and read the files in bounded batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.shared import place_of

#: Names, and bytes of content, that a batch holds.
NAMES, CONTENT = 10_000, 16 << 20
#: Bytes of a file that are read at a time where it does not come at once.
PART = 16 << 20
LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
READ = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])


def _hidden(name: str) -> bool:
    """What Spark's readers of files pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(folder: str, deep: bool, suffix: str) -> Iterator[tuple[str, bool]]:
    """Files of a folder, and its folders that are to be read as well."""
    with os.scandir(folder) as found:
        for entry in found:
            if _hidden(entry.name):
                continue
            if entry.is_dir():
                if deep or "=" in entry.name:
                    yield entry.path, True
            elif entry.name.endswith(suffix):
                yield entry.path, False


def _walk(found: Iterator[tuple[str, bool]], deep: bool, suffix: str) -> Iterator[str]:
    for path, folder in found:
        if folder:
            yield from _walk(_entries(path, deep, suffix), deep, suffix)
        else:
            yield path


def _files(batches: Iterator[pa.RecordBatch], deep: bool, suffix: str) -> Iterator[str]:
    for batch in batches:
        yield from _walk(zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True), deep, suffix)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if len(held) == NAMES or held_bytes >= CONTENT:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _read(path: str) -> tuple[str, bytes, int, int]:
    file = os.open(path, os.O_RDONLY | os.O_CLOEXEC)  # fewer calls to the system than a file object makes
    try:
        state = os.fstat(file)
        content = os.read(file, state.st_size + 1)
        if len(content) != state.st_size:  # read in parts, or changed meanwhile
            parts = [content]
            while parts[-1]:
                parts.append(os.read(file, PART))
            content = b"".join(parts)
    finally:
        os.close(file)
    return f"file:{path}", content, len(content), state.st_mtime_ns // 1_000_000 * 1000


def _local(spark: SparkSession, root: str) -> str | None:
    """The path of a plain folder that the operating system reads, else null."""
    system, place = place_of(spark, root)
    if any(c in root for c in "*?[]{}") or system.getScheme() != "file" or not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    return system.makeQualified(place).toUri().getPath()


def _listed(spark: SparkSession, folder: str, deep: bool, suffix: str) -> DataFrame:
    """``path, folder`` of what is in a folder, dealt out by hash: a task lists it, and with ``deep`` tasks list the folders in it. No list of names is held anywhere."""
    kinds, parts = "path string, folder boolean", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _batches(_entries(folder, deep, suffix), LISTED)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((path, False) for path in _files(batches, deep, suffix)), LISTED)

    top = spark.range(1, numPartitions=1).mapInArrow(tops, kinds).repartition(parts, "path")
    return top.mapInArrow(below, kinds).repartition(parts, "path") if deep else top


def _binary_files(spark: SparkSession, root: str, deep: bool, suffix: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower())
    return (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).load(root)


def read_folder(spark: SparkSession, root: str, deep: bool = False, suffix: str = "") -> DataFrame:
    """``path, content, length, modificationTime`` of the files in ``root`` (and, if ``deep``, in its folders) whose name ends with ``suffix``.

    These are the rows of Spark's ``binaryFile``, which still reads roots that are no plain folder, and those of files without a byte,
    which it leaves out. It lists all names in the driver and weighs each file as 4 MB at least, so that it makes a task of every 32
    files. What is in the folder when the rows are asked for is read.
    """
    folder = _local(spark, root)
    if folder is None:
        return _binary_files(spark, root, deep, suffix).select("path", "content", "length", "modificationTime")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(map(_read, _files(batches, deep, suffix)), READ, lambda row: row[2])

    return _listed(spark, folder, deep, suffix).mapInArrow(contents, "path string, content binary, length bigint, modificationTime timestamp")


def paths_below(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``path`` of the files that ``read_folder`` finds with ``deep``; their content is not read."""
    folder = _local(spark, root)
    if folder is None:
        return _binary_files(spark, root, True, suffix).select("path")
    return _listed(spark, folder, True, suffix).select(F.concat(F.lit("file:"), "path").alias("path"))
