"""One file for each row: texts under their names, images under their class, written by tasks and published at once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a folder or file may not be called.
UNSAFE = re.compile(r"\A\.{0,2}\Z|[/\\\0]|\A_staging-")
#: Names that an error tells.
NAMED = 5
#: Files in a folder that one task fills, if files are spread.
SPREAD = 10_000


def _folder(path: str):
    """The file system of a path that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: int
    attempt: str = ""


class FileWriter(DataSourceWriter):
    """Tasks write into a folder of their own attempt and move what is whole into the job's; the job's folder becomes the table by one move.

    An attempt that fails leaves files in its own folder alone, and one that is repeated moves the same files again. What reaches the
    driver is a number a task. A job that fails removes all of it; tasks that still run then find no folder of the job, which they never make.

    With ``spread``, an attempt fills folders of ``SPREAD`` files, and those of the attempts that count become folders of the table, one
    move for each folder: files that tasks move into one and the same folder wait for each other in the file system, whatever the number of tasks.
    """

    def __init__(self, root: str, overwrite: bool, spread: bool = False) -> None:
        self.root, self.overwrite, self.spread = root.rstrip("/"), overwrite, spread
        parent, _, name = self.root.rpartition("/")
        self.staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
        system, staging = _folder(self.staging)
        for folder in ("attempts", "whole"):
            system.create_dir(f"{staging}/{folder}", recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        system, staging = _folder(self.staging)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        own = f"{staging}/attempts/{attempt}"
        done = 0
        made: set[str] = set()
        for row in rows:
            parts = [p for p in (row["label"], row["name"]) if p is not None]
            if row["name"] is None or any(UNSAFE.search(p) for p in parts):
                raise ValueError(f"no name of a file: {'/'.join(parts)!r}")
            folder = "/".join(parts[:-1])
            tops = (f"{own}/{done // SPREAD}",) if self.spread else (own, f"{staging}/whole")
            for top in tops:
                if (place := f"{top}/{folder}".rstrip("/")) not in made:
                    levels = place.removeprefix(f"{staging}/").split("/")
                    for depth in range(2, len(levels) + 1):
                        system.create_dir("/".join([staging, *levels[:depth]]), recursive=False)
                    made.add(place)
            with system.open_output_stream(f"{tops[0]}/{'/'.join(parts)}") as out:
                out.write(bytes(row["content"] or b""))
            if not self.spread:
                system.move(f"{own}/{'/'.join(parts)}", f"{staging}/whole/{'/'.join(parts)}")
            done += 1
        return Written(done, attempt)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _folder(self.root)
        _, staging = _folder(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.root)
            system.delete_dir(root)
        if self.spread:
            for part, message in enumerate(messages):
                for number in range(-(-message.files // SPREAD)):
                    system.move(f"{staging}/attempts/{message.attempt}/{number}", f"{staging}/whole/{part}-{number}")
        system.move(f"{staging}/whole", root)
        system.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, staging = _folder(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.move(staging, f"{staging}-dropped")  # no task makes a file below a folder that is gone
            system.delete_dir(f"{staging}-dropped")


class FileSink(DataSource):
    """Writes rows of ``label, name, content`` as files ``label/name`` (``name`` where the label is null); with ``spread``, in folders of its own."""

    @classmethod
    def name(cls) -> str:
        return "glyphlake_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite, self.options["spread"] == "true")


def _uneven(rows: DataFrame) -> bool:
    held = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return (held["most"] or 0) * rows.sparkSession.sparkContext.defaultParallelism > 2 * (held["all"] or 0)


def write_files(df: DataFrame, path: str, name: Column, content: Column, label: Column | None = None, overwrite: bool = False, spread: bool = False) -> None:
    """One file for each row: ``content`` (bytes) as ``path/label/name``, or ``path/name`` without a label. Null content is an empty file.

    The folder appears when all files are written, and not at all if one cannot be; names that two rows share are refused. With
    ``spread``, for many files, these places are in numbered folders of ``path`` with at most ``SPREAD`` files each, which tasks fill apart;
    where one task would hold more than twice the share of a core (a table in one row group), rows are dealt out by name first.
    """
    spark = df.sparkSession
    rows = df.select((F.lit(None).cast("string") if label is None else label.cast("string")).alias("label"), name.cast("string").alias("name"), content.alias("content"))
    twice = [f"{r['label'] or ''}/{r['name']}" for r in rows.groupBy("label", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(NAMED).collect()]
    if twice:
        raise ValueError(f"names that several rows have: {', '.join(sorted(twice))}")
    if spread and _uneven(rows):
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "name")
    spark.dataSource.register(FileSink)
    rows.write.format(FileSink.name()).mode("overwrite" if overwrite else "append").option("path", path).option("spread", str(spread).lower()).save()


def write_text_files(df: DataFrame, path: str, name: str = "name", text: str = "text", bom: bool = False, overwrite: bool = False, spread: bool = False) -> None:
    """A text file in UTF-8 for each row; with ``bom`` each begins with a byte order mark. Null texts are empty. ``spread`` as in ``write_files``."""
    body = F.coalesce(F.col(text), F.lit(""))
    write_files(df, path, F.col(name), F.encode(F.concat(F.lit("﻿"), body) if bom else body, "UTF-8"), overwrite=overwrite, spread=spread)


def write_class_dirs(files: DataFrame, path: str, overwrite: bool = False) -> int:
    """Images under their class, as ``read_class_dirs`` reads them; rows without content (files that failed) are left out and counted."""
    failed = files.where("content IS NULL").count()
    write_files(files.where("content IS NOT NULL"), path, F.col("name"), F.col("content"), F.col("label"), overwrite)
    return failed
