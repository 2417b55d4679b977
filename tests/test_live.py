"""Live retention and live latest rows against their batch forms, with restarts, repeats, idle users and compaction."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import history
from glyphlake.sources import fixtures, tables
from glyphlake.streaming import jobs

NAMES = [f.name for f in tables.RECOGNITIONS]
_clock = [1_700_000_000]


def drop(spark, folder, rows):
    """One file of the stream's input; files are read in the order of their times."""
    target = f"{folder}/b{_clock[0]}"
    spark.createDataFrame(rows, tables.RECOGNITIONS).coalesce(1).write.parquet(target)
    _clock[0] += 10
    for name in os.listdir(target):
        os.utime(f"{target}/{name}", (_clock[0], _clock[0]))


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return fixtures.recognized_texts(spark, sf_dir).withColumn("num_lines", F.lit(1)).select(NAMES).orderBy(F.xxhash64("id")).collect()


def row(i, user, at, name="f"):
    return tuple({**dict.fromkeys(NAMES), "id": i, "user_id": user, "file_name": name, "created_at": at}[n] for n in NAMES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_retention_equals_its_batch_forms_across_restarts(spark, rows, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for k in range(0, len(rows), 80):
        drop(spark, folder, rows[k : k + 80])
        if k % 160 == 80 or k + 80 >= len(rows):  # the job ends and starts again in between
            jobs.stream_retained(jobs.stream_recognitions(spark, f"{folder}/*", max_files=1), out, checkpoint).awaitTermination(120)
            seen = spark.createDataFrame(rows[: k + 80], tables.RECOGNITIONS)
            newest = history.retain_newest(seen)
            assert ids(jobs.read_retained(spark, out)) == ids(newest)
            assert ids(jobs.read_expired(spark, out)) == ids(history.expired(seen.select("id"), newest))
    assert len(jobs.numbered(spark, f"{out}/retained", "batch")) <= 2


def test_a_repeated_batch_retains_the_same(spark, tmp_path):
    out = str(tmp_path)
    day = datetime(2024, 1, 1)
    batches = [[(i, day + timedelta(days=i)) for i in range(5)], [(i, day + timedelta(days=i % 3)) for i in range(5, 9)], [(20, None), (21, day + timedelta(days=30))]]
    frames = [spark.createDataFrame(b, jobs.RETAINED) for b in batches]
    for number in (0, 1, 1, 2, 2):
        jobs.retain_batch(frames[number], number, out, 3)
    assert ids(jobs.read_retained(spark, out)) == [3, 4, 21] and ids(jobs.read_expired(spark, out)) == [0, 1, 2, 5, 6, 7, 8, 20]
    assert jobs.read_retained(spark, f"{out}/none").count() == jobs.read_expired(spark, f"{out}/none").count() == 0


def test_idle_users_are_forgotten(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    day = datetime(2024, 1, 1)
    drop(spark, folder, [row(1, 7, day), row(2, 8, day), row(9, None, day), row(None, 8, day), row(3, 8, None)])
    drop(spark, folder, [row(4, 8, day + timedelta(days=9))])
    drop(spark, folder, [row(5, 8, day + timedelta(days=25))])
    drop(spark, folder, [row(6, 8, day + timedelta(days=26))])
    run = lambda: jobs.stream_recent(jobs.stream_recognitions(spark, f"{folder}/*", max_files=1), out, checkpoint, idle_days=20).awaitTermination(120)
    run()
    assert sorted((r["user_id"], r["place"], r["id"]) for r in jobs.read_recent(spark, out).collect()) == [(8, 1, 6), (8, 2, 5), (8, 3, 4), (8, 4, 2)]
    # Of a user who is back, only what comes now is known.
    drop(spark, folder, [row(10, 7, day + timedelta(days=27))])
    run()
    assert sorted((r["place"], r["id"]) for r in jobs.read_recent(spark, out).where("user_id = 7").collect()) == [(1, 10)]


def test_changes_are_compacted(spark, rows, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for k in range(0, len(rows), 50):
        drop(spark, folder, rows[k : k + 50])
    jobs.stream_recent(jobs.stream_recognitions(spark, f"{folder}/*", max_files=1), out, checkpoint, compact_every=3).awaitTermination(240)
    want = sorted((r["user_id"], r["id"]) for r in jobs.latest(spark.createDataFrame(rows, tables.RECOGNITIONS).where("user_id IS NOT NULL")).collect())
    state = lambda: sorted((r["user_id"], r["id"]) for r in jobs.read_recent(spark, out).collect())
    assert state() == want and jobs.numbered(spark, f"{out}/base", "upto") == [2]
    last = jobs.compact_recent(spark, out)
    assert state() == want and jobs.numbered(spark, f"{out}/base", "upto") == [last] and jobs.numbered(spark, f"{out}/changes", "batch") == []
    assert jobs.compact_recent(spark, out) == last and state() == want
    assert jobs.compact_recent(spark, f"{out}/none") == -1
