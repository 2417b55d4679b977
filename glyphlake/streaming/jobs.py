"""Streaming jobs: ingest with a reject sink, live daily trend, live latest rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from glyphlake.operators.ingest import SERVER, Rules, checked_uploads
from glyphlake.sources.shared import numbered, remove
from glyphlake.sources.tables import RECOGNITIONS


def stream_recognitions(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(RECOGNITIONS).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_ingest(uploads: DataFrame, accepted: str, rejected: str, checkpoint: str, rules: Rules = SERVER) -> StreamingQuery:
    """Append valid uploads to ``accepted`` and the others to ``rejected``. A batch is written under its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        seen = checked_uploads(batch, rules).persist()
        for path, rows in ((accepted, seen.where("reject_reason IS NULL").drop("reject_reason")), (rejected, seen.where("reject_reason IS NOT NULL"))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen.unpersist()

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_trend(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per user and day: rows, completed rows, mean confidence in hundredths. Late rows amend a day inside ``delay``; later ones drop."""
    timed = stream.withColumn("at", F.col("created_at").cast("timestamp")).where("user_id IS NOT NULL").withWatermark("at", delay)
    days = timed.groupBy(F.window("at", "1 day"), "user_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("status") == "completed").alias("recognitions"),
        (F.avg(F.coalesce("confidence", F.lit(0.0))) * 100).alias("value"),
    )
    return days.select(F.to_date(F.col("window.start")).alias("day"), "user_id", "documents", "recognitions", "value")


def latest(df: DataFrame, n: int = 8) -> DataFrame:
    at = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("__place", F.row_number().over(at)).where(F.col("__place") <= n).drop("__place")


RECENT = "user_id long, place int, id long, file_name string, confidence double, at long"
#: Event time that rows may be late by before a user counts as idle.
IDLE_DELAY = "1 hour"


def recent_updates(stream: DataFrame, n: int = 8, idle_days: int | None = None) -> DataFrame:
    """Each user's latest ``n`` rows, given anew whenever they change. A user's state is those rows alone, kept by Spark under the user's key.

    With ``idle_days``, a user without rows for so many days of event time is forgotten: the state goes, and a row with place 0 and
    without an id says so. Rows of such a user that come later begin a new state.
    """

    def merge(key, batches, state):
        import pandas as pd

        columns = ["user_id", "place", "id", "file_name", "confidence", "at"]
        gone = pd.DataFrame([(key[0], 0, None, None, None, None)], columns=columns).astype({"id": "Int64", "at": "Int64"})
        if state.hasTimedOut:
            state.remove()
            yield gone
            return
        held = {r[0]: r for r in json.loads(state.get[0])} if state.exists else {}
        for batch in batches:
            for row in batch[["id", "file_name", "confidence", "at"]].astype(object).where(batch.notna(), None).itertuples(index=False):
                held[int(row[0])] = (int(row[0]), row[1], None if row[2] is None else float(row[2]), int(row[3]))
        latest_rows = sorted(held.values(), key=lambda r: (-r[3], -r[0]))[:n]
        if idle_days is not None:
            until = latest_rows[0][3] // 1000 + idle_days * 86_400_000
            if until <= state.getCurrentWatermarkMs():  # idle already
                if state.exists:
                    state.remove()
                yield gone
                return
            state.update((json.dumps(latest_rows),))
            state.setTimeoutTimestamp(until)
        else:
            state.update((json.dumps(latest_rows),))
        yield pd.DataFrame([(key[0], k, *r) for k, r in enumerate(latest_rows, 1)], columns=columns)

    rows = stream.where("user_id IS NOT NULL AND id IS NOT NULL AND created_at IS NOT NULL").withColumn("seen", F.col("created_at").cast("timestamp"))
    if idle_days is not None:
        rows = rows.withWatermark("seen", IDLE_DELAY)
    rows = rows.select("user_id", "id", "file_name", "confidence", F.unix_micros("seen").alias("at"), *(["seen"] if idle_days is not None else []))
    timeout = GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(merge, RECENT, "rows string", "update", timeout)


def stream_recent(stream: DataFrame, out: str, checkpoint: str, n: int = 8, idle_days: int | None = None, compact_every: int | None = None) -> StreamingQuery:
    """Write each batch's changes of the users' latest rows: users without new rows cost nothing, a repeated batch replaces itself.

    After every ``compact_every`` batches the changes so far become one table (``compact_recent``).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        if compact_every and (number + 1) % compact_every == 0:
            compact_recent(batch.sparkSession, out)

    return recent_updates(stream, n, idle_days).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _recent_changes(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """Rows of the last compacted table and of the batches behind it, with their batch; the number of the last batch (-1 if there is none)."""
    bases = numbered(spark, f"{out}/base", "upto")
    upto = bases[-1] if bases else -1
    later = [b for b in numbered(spark, f"{out}/changes", "batch") if b > upto]
    names = RECENT + ", batch long"
    rows = spark.createDataFrame([], names)
    if bases:
        rows = rows.unionByName(spark.read.schema(RECENT).parquet(f"{out}/base/upto={upto}").withColumn("batch", F.lit(upto).cast("long")))
    if later:
        rows = rows.unionByName(spark.read.schema(names).option("basePath", f"{out}/changes").parquet(*[f"{out}/changes/batch={b}" for b in later]))
    return rows, max([upto, *later])


def read_recent(spark: SparkSession, out: str) -> DataFrame:
    """The newest rows of each user that ``stream_recent`` wrote; users who were forgotten are left out."""
    changes, _ = _recent_changes(spark, out)
    newest = changes.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return changes.join(newest.hint("merge"), ["user_id", "batch"]).where("place > 0").drop("batch")


def compact_recent(spark: SparkSession, out: str) -> int:
    """Put the changes so far into one table and delete them; the number of the last batch in it.

    The table is whole before anything goes, and readers take the newest whole one and the batches behind it, so a failure in between
    loses nothing and a second call does the rest.
    """
    _, last = _recent_changes(spark, out)
    bases = numbered(spark, f"{out}/base", "upto")
    if last >= 0 and last not in bases:
        read_recent(spark, out).write.mode("overwrite").parquet(f"{out}/base/upto={last}")
    for number in bases:
        if number < last:
            remove(spark, f"{out}/base/upto={number}")
    for number in numbered(spark, f"{out}/changes", "batch"):
        if number <= last:
            remove(spark, f"{out}/changes/batch={number}")
    return last


RETAINED = "id long, created_at timestamp_ntz"


def retain_batch(batch: DataFrame, number: int, out: str, n: int = 24) -> None:
    """The newest ``n`` rows after a batch, and the rows that it made expire: those of before that lost their place, and its own that got none.

    Each task brings its best ``n`` rows and one merges them; what was retained before is read from the batch before, so a batch that is
    repeated gives the same. Tables of batches before that one are deleted.
    """
    spark = batch.sparkSession
    held = [b for b in numbered(spark, f"{out}/retained", "batch") if b < number]
    rows = batch.select("id", "created_at")
    if held:
        rows = rows.unionByName(spark.read.schema(RETAINED).parquet(f"{out}/retained/batch={held[-1]}"))
    rows = rows.dropDuplicates(["id"]).persist()
    rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n).write.mode("overwrite").parquet(f"{out}/retained/batch={number}")
    best = spark.read.schema(RETAINED).parquet(f"{out}/retained/batch={number}")
    rows.join(F.broadcast(best.select("id")), "id", "left_anti").write.mode("overwrite").parquet(f"{out}/expired/batch={number}")  # n rows
    rows.unpersist()
    for old in held[:-1]:
        remove(spark, f"{out}/retained/batch={old}")


def stream_retained(stream: DataFrame, out: str, checkpoint: str, n: int = 24) -> StreamingQuery:
    """Keep the newest ``n`` documents live, and name those that expire."""
    return stream.writeStream.foreachBatch(lambda batch, number: retain_batch(batch, number, out, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_retained(spark: SparkSession, out: str) -> DataFrame:
    """The documents that are retained after the last batch."""
    done = numbered(spark, f"{out}/retained", "batch")
    return spark.read.schema(RETAINED).parquet(f"{out}/retained/batch={done[-1]}") if done else spark.createDataFrame([], RETAINED)


def read_expired(spark: SparkSession, out: str) -> DataFrame:
    """All documents that have expired so far."""
    return spark.read.schema(RETAINED).parquet(f"{out}/expired") if numbered(spark, f"{out}/expired", "batch") else spark.createDataFrame([], RETAINED)
