"""Dashboard aggregates: totals, average confidence, daily trend, storage, activity, model health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STORAGE_TOTAL = 10 * 1024**3


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Per user: documents, recognitions, mean confidence of completed rows (null as 0), characters, storage."""
    done = F.col("status") == "completed"
    used = F.sum(F.length(F.coalesce("thumbnail", F.lit("")))) * 0.75
    return (
        df.where("user_id IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(done).alias("recognitions"),
            (F.coalesce(F.avg(F.when(done, F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)) * 100).alias("avg_confidence"),
            F.sum(F.coalesce("num_chars", F.lit(0))).cast("long").alias("characters"),
            used.alias("storage_used"),
            (used / STORAGE_TOTAL * 100).alias("storage_percent"),
        )
    )


def client_confidence(df: DataFrame) -> DataFrame:
    """The client's variant: mean over all rows, 0 for a user without a completed one."""
    return df.where("user_id IS NOT NULL").groupBy("user_id").agg((F.when(F.count_if(F.col("status") == "completed") > 0, F.avg(F.coalesce("confidence", F.lit(0.0)))).otherwise(0.0) * 100).alias("avg_confidence"))


def confidence_trend(df: DataFrame, compat: bool = False) -> DataFrame:
    """Per user and day: mean confidence of all rows (null as 0), in hundredths.

    ``compat`` groups by the label alone, so that a day of several years is one point.
    """
    day = F.to_date("created_at")
    label = F.date_format("created_at", "MMM d")
    keys = [label.alias("label")] if compat else [day.alias("day"), label.alias("label")]
    rows = df.where("user_id IS NOT NULL").groupBy("user_id", *keys)
    return rows.agg((F.avg(F.coalesce("confidence", F.lit(0.0))) * 100).alias("value"), F.min("created_at").alias("first_at"))


def with_empty_point(trend: DataFrame, users: DataFrame) -> DataFrame:
    """Users without a point get one of value 0 labelled 'Today'."""
    none = users.select("user_id").join(trend.select("user_id").distinct(), "user_id", "left_anti")
    return trend.select("user_id", "label", "value").unionByName(none.select("user_id", F.lit("Today").alias("label"), F.lit(0.0).alias("value")))


def monthly_delta(df: DataFrame) -> DataFrame:
    """Per user and calendar month from the first to the last with rows: documents, and their change in percent from the month before.

    Months without rows count 0; the change is null in a user's first month and after a month without rows.
    """
    by = df.where("user_id IS NOT NULL AND created_at IS NOT NULL").groupBy("user_id", F.trunc("created_at", "month").alias("month")).agg(F.count(F.lit(1)).alias("documents"))
    ends = by.groupBy("user_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = ends.select("user_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    every = months.join(by.hint("merge"), ["user_id", "month"], "left").select("user_id", "month", F.coalesce("documents", F.lit(0)).alias("documents"))
    before = F.lag("documents").over(Window.partitionBy("user_id").orderBy("month"))
    return every.select("user_id", F.date_format("month", "yyyy-MM").alias("month"), "documents", ((F.col("documents") - before) * 100.0 / F.nullif(before, F.lit(0))).alias("delta_percent"))


def recent_activity(df: DataFrame, n: int = 8) -> DataFrame:
    """The latest ``n`` rows of each user as messages."""
    at = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    tenths = F.floor(F.coalesce("confidence", F.lit(0.0)) * 1000 + 0.5).cast("long")
    shown = F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return (
        df.where("user_id IS NOT NULL")
        .select("user_id", "id", "file_name", "confidence", "created_at", "status", F.row_number().over(at).alias("place"))
        .where(F.col("place") <= n)
        .select("user_id", "place", F.concat(F.lit("activity_"), F.col("id").cast("string")).alias("activity_id"), F.concat(F.lit('Recognized "'), F.col("file_name"), F.lit('" with '), shown, F.lit("% confidence")).alias("message"), "created_at")
    )


def model_status(models: DataFrame, loaded: DataFrame) -> DataFrame:
    """Catalogue models: active if loaded, else degraded."""
    known = loaded.join(F.broadcast(models.select("model_id")), "model_id", "left_semi")  # the catalogue: a few rows
    there = known.select("model_id", F.lit(True).alias("there")).distinct()
    return models.join(F.broadcast(there), "model_id", "left").select("model_id", "name", F.when(F.col("there"), "active").otherwise("degraded").alias("status"))


#: What a client says of a service that does not answer (fixed value).
UNREACHABLE = "Could not reach the health endpoint."


def health_rollup(status: DataFrame) -> DataFrame:
    """Operational if any model is active; ``checked_at`` is the time of the query."""
    up = F.coalesce(F.bool_or(F.col("status") == "active"), F.lit(False))
    message: Column = F.when(up, "All systems operational").otherwise("Running in mock-inference mode — no trained model weights are loaded")
    return status.agg(up.alias("up"), message.alias("message")).select(F.when(F.col("up"), "operational").otherwise("degraded").alias("status"), "message", F.current_timestamp().alias("checked_at"))


def client_health(health: DataFrame, reachable: Column) -> DataFrame:
    """The client's view: the service's own words, or ``down`` where it cannot be reached."""
    return health.withColumn("status", F.when(reachable, F.col("status")).otherwise("down")).withColumn("message", F.when(reachable, F.col("message")).otherwise(UNREACHABLE))
