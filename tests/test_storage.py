"""Deletes and patches of stored tables, the search index, pages by place, batches that repeat."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import dashboard, dataset, history, ingest, layout, search_index
from glyphlake.sources import fixtures, rewrites, tables


@pytest.fixture
def stored(spark, sf_dir, tmp_path):
    rows = fixtures.recognized_texts(spark, sf_dir).withColumn("num_lines", F.lit(1)).select([f.name for f in tables.RECOGNITIONS])
    path = str(tmp_path / "r")
    tables.write_recognitions(rows, path)
    return path


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def content(spark, path):
    return sorted(map(tuple, tables.read_recognitions(spark, path).collect()), key=str)


def test_delete_rewrites_touched_days_alone(spark, stored):
    rows = tables.read_recognitions(spark, stored)
    before, table = files(stored), content(spark, stored)
    victim = rows.orderBy("id").select("id", "user_id", F.to_date("created_at").cast("string").alias("day")).first()
    day = f"day={victim['day']}/"
    other = spark.createDataFrame([(victim["id"], victim["user_id"] + 1)], "id long, user_id long")
    assert rewrites.delete_stored(spark, stored, other) == [] and files(stored) == before  # another user's row
    ids = spark.createDataFrame([(victim["id"], victim["user_id"])] * 2 + [(-1, -1), (None, None)], "id long, user_id long")
    assert rewrites.delete_stored(spark, stored, ids) == [victim["day"]]
    after = files(stored)
    assert {f for f in before if not f.startswith(day)} == {f for f in after if not f.startswith(day)}
    assert content(spark, stored) == [r for r in table if r[0] != victim["id"]]
    # The row is not found any more, and a second delete touches nothing.
    left = tables.read_recognitions(spark, stored)
    assert history.not_found(left, spark.createDataFrame([(victim["id"], victim["user_id"])], "id long, user_id long")).count() == 1
    assert rewrites.delete_stored(spark, stored, ids) == [] and files(stored) == after


def test_a_day_without_rows_is_removed(spark, stored):
    rows = tables.read_recognitions(spark, stored)
    day = rows.groupBy(F.to_date("created_at").alias("day")).count().orderBy("count").first()["day"]
    gone = rows.where(F.to_date("created_at") == F.lit(day)).select("id", "user_id")
    want = [r for r in content(spark, stored) if r[-1].date() != day]
    assert rewrites.delete_stored(spark, stored, gone) == [str(day)]
    assert not (Path(stored) / f"day={day}").exists() and content(spark, stored) == want


def test_users_and_patches(spark, stored):
    rows = tables.read_recognitions(spark, stored)
    user = rows.agg(F.max("user_id")).first()[0]
    table = content(spark, stored)
    names = [f.name for f in tables.RECOGNITIONS]
    rewrites.delete_stored_users(spark, stored, spark.createDataFrame([(user,)], "user_id long"))
    want = [r for r in table if r[names.index("user_id")] != user]
    assert content(spark, stored) == want
    one = want[0][0]
    patch = spark.createDataFrame([(one, "new.png", None), (-5, "x", "y")], "id long, file_name string, status string")
    assert len(rewrites.patch_stored(spark, stored, patch)) == 1
    after = files(stored)
    assert content(spark, stored) == sorted((tuple("new.png" if n == "file_name" and r[0] == one else v for n, v in zip(names, r, strict=True)) for r in want), key=str)
    assert rewrites.patch_stored(spark, stored, patch) == [] and files(stored) == after  # nothing differs any more
    with pytest.raises(ValueError, match="date"):
        rewrites.patch_stored(spark, stored, spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, created_at timestamp_ntz"))


def test_a_change_shuffles_whole_rows_once(spark, tmp_path):
    """Texts that do not compress: what a change writes and shuffles is twice their size, where a join and a copy beside the table made it four times."""
    path, n = str(tmp_path / "w"), 4000
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(16)])
    rows = spark.range(n).select("id", (F.col("id") % 50).alias("user_id"), text.alias("text"), F.timestamp_seconds(F.floor(F.col("id") / 200) % 4 * 86400).cast("timestamp_ntz").alias("created_at"))
    tables.write_recognitions(rows, path)
    size = sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()

    def written():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    for change in (
        lambda: rewrites.delete_stored(spark, path, rows.where("id % 100 = 0").select("id", "user_id")),
        lambda: rewrites.delete_stored_users(spark, path, spark.createDataFrame([(7,)], "user_id long")),
        lambda: rewrites.patch_stored(spark, path, rows.where("id % 9 = 0").select("id", F.lit("new").alias("text"))),
    ):
        before = written()
        assert len(change()) == 4
        assert sum(v for k, v in written().items() if k not in before) < 3 * size
    want = {r["id"]: "new" if r["id"] % 9 == 0 else r["text"] for r in rows.where("id % 100 <> 0 AND user_id <> 7").collect()}
    assert {r["id"]: r["text"] for r in spark.read.parquet(path).collect()} == want


def test_patches_by_other_keys_and_of_users(spark, tmp_path):
    """A key that many rows share, rows that share an id, and a patch that moves rows to another user."""
    path = str(tmp_path / "k")
    rows = [(i % 40, i % 5 if i % 7 else None, "ab"[i % 2], f"f{i % 3}", datetime(2024, 1, 1 + i % 4)) for i in range(120)]
    names = "id long, user_id long, status string, file_name string, created_at timestamp_ntz"
    tables.write_recognitions(spark.createDataFrame(rows, names), path)
    assert len(rewrites.patch_stored(spark, path, spark.createDataFrame([("f1", 9, None), ("f2", None, "c")], "file_name string, user_id long, status string"), "file_name")) == 4
    want = [(i, 9 if f == "f1" else u, "c" if f == "f2" else s, f, c) for i, u, s, f, c in rows]
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "user_id", "status", "file_name", "created_at").collect()), key=str) == sorted(want, key=str)
    assert rewrites.patch_stored(spark, path, spark.createDataFrame([("f1", 9)], "file_name string, user_id long"), "file_name") == []


def test_rows_without_a_date(spark, tmp_path):
    rows = [(i, 1, None if i < 3 else datetime(2024, 1, i)) for i in range(1, 6)]
    path = str(tmp_path / "n")
    tables.write_recognitions(spark.createDataFrame(rows, "id long, user_id long, created_at timestamp_ntz"), path)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    rewrites.delete_stored(spark, path, spark.createDataFrame([(1, 1), (4, 1)], "id long, user_id long"))
    assert ids() == [2, 3, 5]
    rewrites.delete_stored(spark, path, spark.createDataFrame([(2, 1)], "id long, user_id long"))
    assert ids() == [3, 5]


@pytest.mark.parametrize("term,literal", [("SRC1_1", False), ("src1_1", True), (" rc1%_4 ", False), ("zzzzqq", False), ("ab", False), ("", False), ("a_b", False), ("é", True), ("tion", False)])
def test_indexed_search_finds_the_same_rows(spark, stored, term, literal):
    index = f"{stored}_index"
    assert search_index.write_index(spark, stored, index) == len(files(stored))
    assert search_index.write_index(spark, stored, index) == 0
    table = tables.read_recognitions(spark, stored)
    found, read = search_index.indexed_search(spark, stored, index, term, literal)
    want = sorted(r["id"] for r in table.where(history.matches(term, literal)).collect())
    assert sorted(r["id"] for r in found.collect()) == want
    if term in ("zzzzqq", "src1_1"):
        assert read < len(files(stored)) and len(found.inputFiles()) == read  # files that cannot match are not read
    if not search_index.grams_of(spark, term, literal):
        assert read is None


def test_index_follows_the_table(spark, stored):
    index = f"{stored}_index"
    search_index.write_index(spark, stored, index)
    row = tables.read_recognitions(spark, stored).orderBy("id").limit(1)
    tables.write_recognitions(row.withColumn("id", F.lit(-7).cast("long")).withColumn("text", F.lit("an Unheard-Of word नेपाल")).select([f.name for f in tables.RECOGNITIONS]), stored)
    find = lambda term: [r["id"] for r in search_index.indexed_search(spark, stored, index, term)[0].collect()]
    assert find("unheard-of") == [-7] and find("नेपाल") == [-7]  # a file that is not indexed yet is read
    assert search_index.write_index(spark, stored, index) == 1
    assert find("unheard-of") == [-7] and search_index.indexed_search(spark, stored, index, "unheard-of")[1] == 1
    rewrites.delete_stored(spark, stored, spark.createDataFrame([(-7, row.first()["user_id"])], "id long, user_id long"))
    assert find("unheard-of") == []


def test_sought_and_placed_pages_cover_the_sort(spark):
    rows = [(i, i % 3 if i % 10 else None, None if i % 7 == 0 else (i * 37 % 11) / 10, None if i % 5 == 0 else f"f{i % 4}", datetime(2024, 1, 1 + i % 9)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, user_id long, confidence double, file_name string, created_at timestamp_ntz")
    for sort_by in ("date", "confidence", "name"):
        for way in ("asc", "desc"):
            name = history.SORT_COLUMNS[sort_by]
            own = df.where("user_id = 1")
            whole = [r["id"] for r in own.orderBy(*history.order_of(sort_by, way)).collect()]
            ids, last = [], None
            while True:
                page = history.history(df, 1, sort_by=sort_by, sort_dir=way, page_size=29, after=last).collect()
                if not page:
                    break
                ids += [r["id"] for r in page]
                last = (page[-1][name], page[-1]["id"])
            assert ids == whole
            table = history.page_table(df, sort_by, way)
            assert [r["id"] for p in (1, 2, 3, 4, 5) for r in history.page_of(table, p, 20, user_id=1).collect()] == whole[:100]
            nobody = [r["id"] for r in df.where("user_id IS NULL").orderBy(*history.order_of(sort_by, way)).collect()]
            assert [r["id"] for r in history.page_of(table, 2, 10, user_id=None).collect()] == nobody[10:20]
    assert history.page_of(table, 10_000, 20, user_id=1).collect() == []


def test_a_deep_page_reads_its_place_alone(spark):
    df = spark.range(200_000).select("id", F.lit(1).alias("user_id"), F.timestamp_seconds("id").alias("created_at"))
    page = history.page_of(history.page_table(df), 1500, 100, user_id=1)
    assert [r["id"] for r in page.collect()] == list(range(200_000 - 149_901, 200_000 - 150_001, -1))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "__at" in plan.split("PushedFilters")[1][:200]


def test_history_with_users(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, user_id long")
    users = spark.createDataFrame([(7, "A", "Admin", "x")], "id long, full_name string, role string, email string")
    got = {r["id"]: r["full_name"] for r in history.with_users(rows, users).collect()}
    assert got == {1: "A", 2: None, 3: None} and [r["id"] for r in history.with_users(rows, users, required=True).collect()] == [1]


def test_month_over_month_spans_empty_months(spark):
    days = ["2023-11-03", "2023-11-30", "2024-01-31", "2024-02-01", "2024-02-29", "2024-02-29"]
    df = spark.createDataFrame([(i, 1, datetime.fromisoformat(d)) for i, d in enumerate(days)] + [(99, 2, datetime(2024, 6, 1)), (100, None, datetime(2024, 1, 1)), (101, 2, None)], "id long, user_id long, created_at timestamp_ntz")
    got = sorted((r["user_id"], r["month"], r["documents"], r["delta_percent"]) for r in dashboard.monthly_delta(df).collect())
    assert got == [(1, "2023-11", 2, None), (1, "2023-12", 0, -100.0), (1, "2024-01", 1, None), (1, "2024-02", 3, 200.0), (2, "2024-06", 1, None)]


def test_exact_split_has_the_published_sizes_and_comes_back(spark, tmp_path):
    df = spark.range(92_000).withColumnRenamed("id", "sample_id")
    parts = dataset.split(df, "sample_id", seed=42, exact=True)
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts == {"train": 73_600, "valid": 9_200, "test": 9_200}
    parts.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    again = dataset.split(df.orderBy(F.desc("sample_id")).repartition(7), "sample_id", seed=42, exact=True)
    assert tuple(dataset.check_split(back, again, "sample_id").first()) == (0, 0)
    assert dataset.check_split(back, dataset.split(df, "sample_id", seed=43, exact=True), "sample_id").first()["moved"] > 20_000
    plain = {r["split"]: r["count"] for r in dataset.split(df, "sample_id", seed=42).groupBy("split").count().collect()}
    assert abs(plain["train"] - 73_600) < 600


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    ups = spark.createDataFrame([("n1", "a.png"), ("n2", "b.png")], "landing_name string, name string").withColumn("uploaded_at", F.lit(datetime(2024, 1, 1)))
    results = spark.createDataFrame([("n1", "t1"), ("n2", "t2")], "landing_name string, text string")
    for batch in (1, 2, 2, 1):
        ingest.append_recognitions(ups, results, str(tmp_path / "d"), str(tmp_path / "r"), batch=batch)
    docs, recs = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "r"))
    assert docs.count() == recs.count() == 4 and recs.join(docs, (recs["document_id"] == docs["id"]) & (recs["batch"] == docs["batch"])).count() == 4


def test_cells_beyond_the_grid_are_kept(spark):
    cells = spark.createDataFrame([(1, 0, c, f"t{c}", 10 * c, c) for c in range(5)] + [(1, 1, 0, "a", 0, 0), (2, 0, None, "whole", 0, 0)], "page_id long, row_no int, col int, text string, x int, line_no int")
    got = {(r["page_id"], r["row_no"]): (r["c0"], r["c1"], r["more"]) for r in layout.cell_grid(cells, 2).collect()}
    assert got == {(1, 0): ("t0", "t1", ["t2", "t3", "t4"]), (1, 1): ("a", None, None), (2, 0): ("whole", None, None)}


def test_trigrams_are_those_inside_each_text():
    from glyphlake.operators import search_index

    texts = ["abcab", "", "x", "yz", "कखग😀क", "\x00\x00\x00", "abc"]
    want = {t[i : i + 3] for t in texts for i in range(len(t) - 2)}
    found = search_index._spelt(search_index._grams(texts))
    assert set(found) == want and len(found) == len(want)
    assert all(search_index._spelt(search_index._grams([t])) == [] for t in ("", "x", "yz"))


def test_postings_tell_a_trigram_of_a_file_once_before_the_shuffle(spark, tmp_path):
    from glyphlake.operators import search_index

    spark.createDataFrame([(f"F{i % 3}.PNG", "same text" if i % 2 else None) for i in range(400)], "file_name string, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    found = search_index.postings(spark.read.parquet(str(tmp_path / "t")))
    assert {(r["column"], r["trigram"]) for r in found.collect()} == {("file_name", g) for n in range(3) for g in (f"f{n}.", f"{n}.p", ".pn", "png")} | {("text", "same text"[i : i + 3]) for i in range(7)}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
