"""Files for each row, pages in bounded batches, recognisers in batches."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import recognise
from glyphlake.sources import files, folders, tables


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("*") if p.is_file()}


def test_a_text_file_for_each_document(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "नेपाल\nx"), ("b.txt", None), ("c.txt", "")], "name string, text string").repartition(3)
    files.write_text_files(df, str(tmp_path / "t"))
    assert tree(tmp_path / "t") == {"a.txt": "नेपाल\nx".encode(), "b.txt": b"", "c.txt": b""}
    files.write_text_files(df, f"file://{tmp_path / 'u'}", bom=True)
    assert tree(tmp_path / "u")["a.txt"] == "﻿नेपाल\nx".encode()
    with pytest.raises(Exception, match="FileExists"):
        files.write_text_files(df, str(tmp_path / "t"))
    files.write_text_files(df.limit(1), str(tmp_path / "t"), overwrite=True)
    assert len(tree(tmp_path / "t")) == 1 and not list(tmp_path.glob("_staging*"))
    files.write_text_files(df.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none").is_dir() and tree(tmp_path / "none") == {}


def test_images_lie_under_their_class(spark, tmp_path):
    rows = [(f"digit_{i % 3}", f"{i}.png", None if i == 7 else bytes([i, 255])) for i in range(40)]
    df = spark.createDataFrame(rows, "label string, name string, content binary").repartition(5)
    assert files.write_class_dirs(df, str(tmp_path / "c")) == 1
    assert tree(tmp_path / "c") == {f"{label}/{name}": c for label, name, c in rows if c}
    back = {(r["label"], r["name"], bytes(r["content"])) for r in tables.read_class_dirs(spark, str(tmp_path / "c")).collect()}
    assert back == {r for r in rows if r[2]}
    done = recognise.map_directory(tables.read_class_dirs(spark, str(tmp_path / "c")), lambda b: b[::-1])
    assert files.write_class_dirs(done, str(tmp_path / "d")) == 0
    assert tree(tmp_path / "d") == {k: v[::-1] for k, v in tree(tmp_path / "c").items()}


@pytest.mark.parametrize("bad", ["../x", "a/b", "..", "", None])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"{i}.txt", "t") for i in range(30)] + [(bad, "t")]
    with pytest.raises(Exception, match="no name of a file"):
        files.write_text_files(spark.createDataFrame(rows, "name string, text string").repartition(4), str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []


def test_shared_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="/a"):
        files.write_text_files(spark.createDataFrame([("a", "1"), ("a", "2")], "name string, text string"), str(tmp_path / "t"))


def test_a_repeated_attempt_moves_the_same_files(spark, tmp_path):
    """A task that ran, and whose attempt is run again, gives each file once."""
    from unittest import mock

    writer = files.FileWriter(str(tmp_path / "t"), False)
    rows = [{"label": "x", "name": f"{i}", "content": b"c"} for i in range(3)]
    for attempt in (1, 2):
        with mock.patch.object(files, "TaskContext") as context:
            context.get.return_value.partitionId.return_value, context.get.return_value.taskAttemptId.return_value = 0, attempt
            message = writer.write(iter(rows))
    assert message.files == 3 and not (tmp_path / "t").exists()
    writer.commit([message])
    assert tree(tmp_path) == {f"t/x/{i}": b"c" for i in range(3)}


def test_pages_are_held_in_bounded_lists(spark):
    asked = []

    def splitter(value):
        for i in range(10_000):
            asked.append(i)
            yield b"x" * 100_000

    seen = 0
    for pages in recognise.page_batches([(1, "file")], splitter, most_bytes=1 << 20, most_rows=500):
        assert len(asked) - seen == len(pages) <= 11 and sum(len(p) for _, _, p in pages) <= (1 << 20) + 100_000
        assert [n for _, n, _ in pages] == list(range(seen + 1, seen + len(pages) + 1))
        seen += len(pages)
    assert seen == 10_000
    assert [len(b) for b in recognise.page_batches([(1, ""), (2, "ab"), (3, "c")], list, most_rows=2)] == [2, 1]
    df = spark.createDataFrame([(i, f"{i}") for i in range(3)], "id long, content string")
    got = recognise.fan_out_pages(df, lambda v: (f"{v}-{k}" for k in range(2500)), "id")
    assert got.count() == 7500 and got.agg(F.count_distinct("id", "page")).first()[0] == 7500


class Reader:
    """Reads values in batches; ``sizes`` are those of the batches."""

    def __call__(self, value):
        if value == "bad":
            raise ValueError("no")
        return {"text": f"one {value}", "confidence": 0.5}

    def predict_batch(self, values):
        if "bad" in values:
            raise RuntimeError("batch")
        return [{"text": f"{len(values)} {v}", "confidence": 1} for v in values]


def test_recognisers_get_batches_and_failures_stay_single(spark):
    df = spark.createDataFrame([(i, "bad" if i == 9 else f"v{i}") for i in range(12)], "id int, content string").coalesce(1)
    got = {r["id"]: (r["text"], r["confidence"], r["error"]) for r in recognise.recognise(df.orderBy("id").coalesce(1), Reader, batch_size=4).collect()}
    assert got[0] == ("4 v0", 1.0, None) and got[8] == ("one v8", 0.5, None) and got[9] == (recognise.FALLBACK_TEXT, 0.0, "ValueError: no")
    short = recognise.recognise(df.limit(3), lambda: type("Short", (), {"predict_batch": staticmethod(lambda v: [{"text": "x", "confidence": 1}])})())
    assert {r["text"] for r in short.collect()} == {"x"}  # too few answers for three: asked again one by one


def test_all_models_share_one_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, content string").write.parquet(str(tmp_path / "in"))
    both = recognise.run_models(spark.read.parquet(str(tmp_path / "in")), {"crnn": None, "transformer": Reader})
    assert both.count() == 20 and both.where("model = 'crnn' AND model_simulated").count() == 10
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInPandas") == 1


def test_folders_are_read_by_tasks_as_binary_files_are(spark, tmp_path):
    """The rows of Spark's reader, and empty files; a task holds many files, and hidden ones and folders are passed over."""
    root = tmp_path / "a b"
    for i in range(3000):
        place = root / f"c{i % 3}" / ("deeper" if i % 2 else "") / f"{i} %.png"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"x" * (i % 50))
    for name in ("top.png", "top.txt", "é.png", ".hidden.png", "_hidden.png", "_k=v.png", "c0/x.txt", "_no/y.png", "k=1/z.png", "k=1/w=2/z.png", "x._COPYING_"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(name.encode())
    (tmp_path / "none").mkdir()
    columns = ["path", "content", "length", "modificationTime"]
    for options, deep, suffix in (({"recursiveFileLookup": "true", "pathGlobFilter": "*.png"}, True, ".png"), ({"recursiveFileLookup": "true"}, True, "")):
        got = folders.read_folder(spark, str(root), deep, suffix)
        want = {tuple(r) for r in spark.read.format("binaryFile").options(**options).load(str(root)).select(columns).collect()}
        rows = {tuple(r) for r in got.collect()}
        assert {r for r in rows if r[2]} == want and got.count() == len(rows) and got.columns == columns
        assert len(rows) == len(want) + 60  # files without a byte, which Spark's reader leaves out
        assert got.rdd.getNumPartitions() <= 4  # of 3,000 files; Spark's reader makes 94 tasks
    for flat in ("c0", "none"):
        want = {tuple(r) for r in spark.read.format("binaryFile").load(str(root / flat) if flat == "c0" else str(tmp_path / flat)).select(columns).collect()}
        assert {tuple(r) for r in folders.read_folder(spark, f"file://{root / flat}" if flat == "c0" else str(tmp_path / flat)).where("length > 0").collect()} == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folders.read_folder(spark, str(tmp_path / "missing"))
    assert folders.read_folder(spark, str(root / "c*"), True, ".txt").count() == 1
    assert folders.paths_below(spark, str(root), ".txt").count() == 2


def test_a_mapped_folder_is_mapped_once(spark, sf_dir):
    """Names, failures and files are taken from what the kernel made once, so what is left to run has no kernel in it."""
    from glyphlake.plans import job_queries

    plan = job_queries.QUERIES["x5_mapped_images"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "mapped" in plan and "map_directory" not in plan and "MapInPandas" not in plan


def test_every_upload_comes_back_with_an_empty_one(spark, tmp_path):
    df = spark.createDataFrame([("a.png", b"x"), ("b.png", None), ("c.png", b"")], "name string, content binary")
    files.write_files(df, str(tmp_path / "t"), F.col("name"), F.col("content"))
    assert {(r["name"], r["n_bytes"], bytes(r["content"])) for r in tables.read_uploads(spark, str(tmp_path / "t")).collect()} == {("a.png", 1, b"x"), ("b.png", 0, b""), ("c.png", 0, b"")}


@pytest.mark.parametrize("spread", [False, True])
def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path, spread):
    from unittest import mock

    writer = files.FileWriter(str(tmp_path / "t"), False, spread)

    def rows():
        yield {"label": "x", "name": "a", "content": b"c"}
        writer.abort([])
        yield {"label": "y", "name": "b", "content": b"c"}

    with mock.patch.object(files, "TaskContext") as context:
        context.get.return_value.partitionId.return_value, context.get.return_value.taskAttemptId.return_value = 0, 1
        for late in (rows(), iter([{"label": None, "name": "c", "content": b"c"}])):
            with pytest.raises(FileNotFoundError):
                writer.write(late)
    assert list(tmp_path.iterdir()) == []


def test_tasks_fill_folders_of_their_own(tmp_path, monkeypatch):
    """No file is moved alone: folders of bounded size go into the table, those of the attempts that count."""
    from unittest import mock

    monkeypatch.setattr(files, "SPREAD", 2)
    writer = files.FileWriter(str(tmp_path / "t"), False, spread=True)
    messages = []
    for part, attempt, names in ((0, 1, "abc"), (0, 2, "abcde"), (1, 3, ""), (2, 4, "fg")):
        with mock.patch.object(files, "TaskContext") as context:
            context.get.return_value.partitionId.return_value, context.get.return_value.taskAttemptId.return_value = part, attempt
            messages.append(writer.write(iter([{"label": None, "name": n, "content": n.encode()} for n in names])))
    assert not [p for p in tmp_path.rglob("*") if p.parent.name == "whole"]
    writer.commit(messages[1:])
    assert tree(tmp_path) == {f"t/{place}": place[-1:].encode() for place in ("0-0/a", "0-0/b", "0-1/c", "0-1/d", "0-2/e", "2-0/f", "2-0/g")}


def test_spread_files_are_written_by_several_tasks_and_read_back(spark, tmp_path):
    """A table that is one partition is dealt out to tasks, each with a folder of its own."""
    df = spark.createDataFrame([(f"l{i % 2}", f"{i}.png", bytes([i]) if i else None) for i in range(60)], "label string, name string, content binary").coalesce(1)
    files.write_files(df, str(tmp_path / "t"), F.col("name"), F.col("content"), spread=True)
    assert not list(tmp_path.glob("_staging*")) and len(list((tmp_path / "t").iterdir())) == 4 and not [p for p in (tmp_path / "t").iterdir() if p.is_file()]
    assert sorted((r["name"], bytes(r["content"])) for r in tables.read_uploads(spark, str(tmp_path / "t"), deep=True).collect()) == sorted((f"{i}.png", bytes([i]) if i else b"") for i in range(60))
    files.write_files(df, str(tmp_path / "c"), F.col("name"), F.col("content"), F.col("label"), spread=True)
    assert {(r["label"], r["name"]) for r in tables.read_class_dirs(spark, str(tmp_path / "c")).collect()} == {(f"l{i % 2}", f"{i}.png") for i in range(60)}
    even = spark.range(600, numPartitions=6).select(F.col("id").cast("string").alias("name"))
    files.write_files(even, str(tmp_path / "e"), F.col("name"), F.lit(b"x"), spread=True)
    assert sorted(len(list(p.iterdir())) for p in (tmp_path / "e").iterdir()) == [100] * 6  # written where they lie, without a shuffle
    files.write_files(df.limit(0), str(tmp_path / "none"), F.col("name"), F.col("content"), spread=True)
    assert list((tmp_path / "none").iterdir()) == []


@pytest.mark.parametrize("query", ["s3_uploaded_files", "s7_text_files", "s7_text_files_with_mark"])
def test_many_files_do_not_share_a_folder(spark, sf_dir, monkeypatch, query):
    from glyphlake.plans import job_queries

    read, roots = tables.read_uploads, []
    monkeypatch.setattr(tables, "read_uploads", lambda spark, path, **options: roots.append(Path(path.removeprefix("file://"))) or read(spark, path, **options))
    rows = job_queries.QUERIES[query](spark, sf_dir).count()
    below = list(roots[0].iterdir())
    assert len(below) == 4 and all(p.is_dir() for p in below) and sum(len(list(p.iterdir())) for p in below) == rows


def test_models_that_are_not_there_need_no_python(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, content string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    fixed = (recognise.FALLBACK_TEXT, 0.95, True, None)
    alone = recognise.recognise(df, None)
    assert alone.columns == ["id", "content", *recognise.FOUND] and "MapIn" not in plan(alone)
    assert {tuple(r) for r in alone.collect()} == {(i, f"v{i}", *fixed) for i in range(10)}
    two = recognise.run_models(df, {"a": None, "b": None})
    assert "MapIn" not in plan(two) and sorted(map(tuple, two.collect())) == sorted((i, f"v{i}", *fixed, m) for i in range(10) for m in "ab")
    four = recognise.run_models(df, {"a": None, "b": Reader, "c": None, "d": Reader}, batch_size=64)
    assert four.columns == ["id", "content", *recognise.FOUND, "model"]
    want = [(i, f"v{i}", *(fixed if m in "ac" else (f"10 v{i}", 1.0, False, None)), m) for i in range(10) for m in "abcd"]
    assert sorted((tuple(r) for r in recognise.run_models(df.coalesce(1), {"a": None, "b": Reader, "c": None, "d": Reader}).collect()), key=str) == sorted(want, key=str)
