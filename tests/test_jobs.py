"""Sources, sinks, recognisers and streaming jobs."""

from __future__ import annotations

import runpy
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import dashboard, history, ingest, layout, recognise
from glyphlake.sources import fixtures, tables
from glyphlake.streaming import jobs


def test_uploads_are_read_and_checked(spark, tmp_path):
    for name, size in (("a.png", 3), ("b.exe", 3), ("c.PDF", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = tables.read_uploads(spark, str(tmp_path))
    seen = {r["name"]: r["reject_reason"] for r in ingest.checked_uploads(files).collect()}
    assert seen == {"a.png": None, "b.exe": "extension", "c.PDF": None}
    names = [r[0] for r in files.select(ingest.landing_name(F.col("name"))).collect()]
    assert len(set(names)) == 3 and all(len(n.split("_")[0]) == 32 for n in names)


def test_class_folders(spark, tmp_path):
    for label in ("digit_1", "other"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "x.png").write_bytes(b"1")
        (tmp_path / label / "y.txt").write_bytes(b"2")
    charset = spark.createDataFrame([("digit_1",)], "label string")
    assert [(r["label"], r["name"]) for r in tables.read_class_dirs(spark, str(tmp_path), charset).collect()] == [("digit_1", "x.png")]
    done = recognise.map_directory(tables.read_class_dirs(spark, str(tmp_path)), lambda b: b + b if b == b"1" else 1 / 0)
    assert {(r["label"], bytes(r["content"])) for r in done.collect()} == {("digit_1", b"11"), ("other", b"11")}


def test_recogniser_falls_back(spark):
    pages = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, content string")

    def load():
        def predict(value):
            if value == "bad":
                raise ValueError("no")
            return {"text": value.upper(), "confidence": 0.5}

        return predict

    got = {r["id"]: (r["text"], r["confidence"], r["model_simulated"], r["error"]) for r in recognise.recognise(pages, load).collect()}
    assert got == {1: ("OK", 0.5, False, None), 2: (recognise.FALLBACK_TEXT, 0.0, False, "ValueError: no")}
    both = recognise.run_models(pages, {"crnn": None, "transformer": load})
    assert both.where("model = 'crnn' AND model_simulated").count() == 2
    assert recognise.choose_engine(None, load) is load


def test_pages_fan_out(spark):
    files = spark.createDataFrame([(1, "a|b|c"), (2, "")], "id int, content string")
    got = recognise.fan_out_pages(files, lambda v: v.split("|") if v else [], "id").collect()
    assert [(r["id"], r["page"], r["content"]) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


def test_history_pages_cover_the_sort(spark, sf_dir):
    rows = fixtures.recognized_texts(spark, sf_dir).persist()
    user = rows.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    whole = [r["id"] for r in rows.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id")).collect()]
    pages = [r["id"] for p in range(1, len(whole) // 5 + 2) for r in history.history(rows, user, page=p, page_size=5).collect()]
    assert pages == whole
    assert history.history_count(rows, user).first()["total"] == len(whole)
    assert history.history(rows, user, page_size=1000).count() <= history.MAX_PAGE
    left = history.delete_ids(rows, rows.where(F.col("user_id") == user).limit(1))
    assert left.count() == rows.count() - 1 and history.delete_ids(left, rows.limit(0)).count() == left.count()


def test_append_writes_both_tables(spark, tmp_path):
    ups = spark.createDataFrame([("n1", "a.png"), ("n2", "b.png")], "landing_name string, name string").withColumn("uploaded_at", F.current_timestamp())
    results = spark.createDataFrame([("n1", "t1"), ("n2", "t2")], "landing_name string, text string")
    ingest.append_recognitions(ups, results, str(tmp_path / "d"), str(tmp_path / "r"))
    docs, recs = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "r"))
    assert recs.join(docs, recs["document_id"] == docs["id"]).count() == 2


def test_text_sink_marks_order(spark, tmp_path):
    tables.write_text(spark.createDataFrame([("क",)], "text string"), str(tmp_path / "t"), bom=True)
    (part,) = [p for p in (tmp_path / "t").glob("part-*") if p.stat().st_size]
    assert part.read_bytes() == "\ufeffक\n".encode()


def stream_input(spark, sf_dir, tmp_path):
    rows = fixtures.recognized_texts(spark, sf_dir).withColumn("num_lines", F.lit(1)).select([f.name for f in tables.RECOGNITIONS])
    ordered = rows.orderBy("created_at").collect()
    for k in range(0, len(ordered), 70):
        spark.createDataFrame(ordered[k : k + 70], tables.RECOGNITIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:05d}"))
    return rows, str(tmp_path / "in" / "*")


def test_stream_trend_matches_batch(spark, sf_dir, tmp_path):
    rows, path = stream_input(spark, sf_dir, tmp_path)
    trend = jobs.stream_daily_trend(jobs.stream_recognitions(spark, path), "400 days")
    q = trend.writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["user_id"], str(r["day"])): round(r["value"], 6) for r in spark.table("trend").collect()}
    want = {(r["user_id"], str(r["day"])): round(r["value"], 6) for r in dashboard.confidence_trend(rows).collect()}
    assert got == want


def test_stream_recent_matches_batch(spark, sf_dir, tmp_path):
    rows, path = stream_input(spark, sf_dir, tmp_path)
    q = jobs.stream_recent(jobs.stream_recognitions(spark, path, max_files=1), str(tmp_path / "s"), str(tmp_path / "c"))
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted((r["user_id"], r["place"], r["id"]) for r in jobs.read_recent(spark, str(tmp_path / "s")).collect())
    want = sorted((r["user_id"], r["place"], int(r["activity_id"].split("_")[1])) for r in dashboard.recent_activity(rows).collect())
    assert got == want


def test_stream_trend_amends_and_drops_late_rows(spark, tmp_path):
    batches = [[(1, "2024-01-01 10:00", 0.2)], [(2, "2024-01-10 10:00", 0.4)], [(3, "2024-01-10 02:00", 0.6)], [(4, "2024-01-02 10:00", 0.9)], [(5, "2024-01-11 01:00", 1.0)]]
    empty = dict.fromkeys(f.name for f in tables.RECOGNITIONS)
    for k, rows in enumerate(batches):
        full = [tuple((empty | {"id": i, "user_id": 7, "status": "completed", "confidence": c, "created_at": datetime.fromisoformat(at)}).values()) for i, at, c in rows]
        spark.createDataFrame(full, tables.RECOGNITIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        time.sleep(1.1)  # files are read in the order of their times
    seen = {}

    def note(batch, number):
        seen.update({str(r["day"]): (r["documents"], round(r["value"], 6)) for r in batch.collect()})

    trend = jobs.stream_daily_trend(jobs.stream_recognitions(spark, str(tmp_path / "in" / "*"), max_files=1), "1 day")
    trend.writeStream.foreachBatch(note).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    # The row of the 2nd came after the 10th and is dropped; that of the same day amends it.
    assert seen == {"2024-01-01": (1, 20.0), "2024-01-10": (2, 50.0), "2024-01-11": (1, 100.0)}


def test_readers_and_recognition_sink(spark, sf_dir, tmp_path):
    rows = fixtures.recognized_texts(spark, sf_dir).withColumn("num_lines", F.lit(1)).select([f.name for f in tables.RECOGNITIONS])
    tables.write_recognitions(rows, str(tmp_path / "r"))
    back = tables.read_recognitions(spark, str(tmp_path / "r"))
    assert back.schema.fieldNames() == rows.schema.fieldNames()
    assert sorted(map(str, history.history_items(back).collect())) == sorted(map(str, history.history_items(rows).collect()))
    docs = fixtures.document_images(spark, sf_dir).withColumn("saved_path", F.lit("p")).withColumn("uploaded_at", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    docs.write.parquet(str(tmp_path / "d"))
    assert tables.read_documents(spark, str(tmp_path / "d")).count() == docs.count()
    users = spark.createDataFrame([(1, "A", "a@b.co", "hash", "u", "Admin", None, datetime(2024, 1, 1))], tables.USERS)
    users.write.parquet(str(tmp_path / "u"))
    assert "password_hash" not in tables.read_users(spark, str(tmp_path / "u")).columns and tables.read_users(spark, str(tmp_path / "u")).first()["email"] == "a@b.co"


def test_layout_sinks(spark, sf_dir, tmp_path):
    boxes = fixtures.line_boxes(spark, sf_dir)
    lines = layout.text_layer(boxes, fixtures.PAGE_W)
    tables.write_text_layer(lines, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.count() == lines.count() and back.groupBy("page_id").agg(F.countDistinct("bucket").alias("n")).where("n > 1").isEmpty()
    cells = layout.rows_anchored(boxes)
    grid = layout.cell_grid(layout.assign_cells(cells, layout.column_ranges(cells)), 3)
    tables.write_cells(grid, str(tmp_path / "g"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "g")).collect())) == sorted(map(str, grid.collect()))


def test_unknown_labels_are_named(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.png").write_bytes(b"1")
    with pytest.warns(UserWarning, match="other"):
        assert tables.read_class_dirs(spark, str(tmp_path), spark.createDataFrame([("digit_1",)], "label string")).count() == 0


def test_search_takes_a_backslash_as_a_letter(spark):
    rows = spark.createDataFrame([(1, 1, "C:\\new", "x"), (2, 1, "a", "50%_off"), (3, 1, "b", "plain")], "id int, user_id int, file_name string, text string")
    found = lambda term: [r["id"] for r in history.filtered(rows, search=term).orderBy("id").collect()]
    assert found("C:\\NEW") == [1] and found("\\") == [1] and found("0%o") == [2] and found("pl_in") == [3]


def test_an_unrelated_missing_package_is_seen(monkeypatch):
    import builtins

    real = builtins.__import__

    def blocked(name, *args, **kw):
        if name in ("corpus_pipeline", "xxhash_missing"):
            raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", blocked)
    with pytest.raises(ModuleNotFoundError):
        runpy.run_path(str(Path(__file__).resolve().parent.parent / "__spark_entry__.py"))


def test_stream_ingest_splits(spark, tmp_path):
    spark.createDataFrame([("a.png", 5), ("b.exe", 5), ("c.pdf", 30 * 1024**2)], "name string, n_bytes long").write.parquet(str(tmp_path / "in"))
    ups = spark.readStream.schema("name string, n_bytes long").parquet(str(tmp_path / "in"))
    jobs.stream_ingest(ups, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "c")).awaitTermination(60)
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["a.png"]
    assert {r["name"]: r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "no")).collect()} == {"b.exe": "extension", "c.pdf": "size"}
