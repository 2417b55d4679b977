"""Uploads and sign-ups: validation, admission, append, patch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.functions.text import extension


@dataclass(frozen=True)
class Rules:
    extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "tiff", "pdf")
    max_mb: int = 20
    #: MIME types that are accepted whatever the extension.
    types: tuple[str, ...] = ()


SERVER, CLIENT = Rules(), Rules(extensions=("jpg", "jpeg", "png", "pdf"), types=("image/jpeg", "image/png", "image/jpg", "application/pdf"))


def checked_uploads(df: DataFrame, rules: Rules = SERVER) -> DataFrame:
    """``df`` with ``ext`` and ``reject_reason`` (null if accepted); the extension, or ``mime_type`` if the rules name types, is looked at first."""
    ext = extension(F.col("name"))
    known = ext.isin(*rules.extensions)
    if rules.types and "mime_type" in df.columns:
        known = known | F.coalesce(F.col("mime_type").isin(*rules.types), F.lit(False))
    reason = F.when(~known, "extension").when(F.col("n_bytes") > rules.max_mb * 1024**2, "size")
    return df.withColumn("ext", ext).withColumn("reject_reason", reason)


def validate_uploads(df: DataFrame, rules: Rules = SERVER) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows."""
    seen = checked_uploads(df, rules)
    return seen.where("reject_reason IS NULL").drop("reject_reason"), seen.where("reject_reason IS NOT NULL")


def is_pdf(name: Column, head: Column) -> Column:
    """By name or by the first five bytes."""
    return F.endswith(F.lower(name), F.lit(".pdf")) | (F.substring(head, 1, 5) == F.lit(b"%PDF-"))


def landing_name(name: Column) -> Column:
    """A name that no other upload has."""
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("_"), name)


def admit_new_keys(new: DataFrame, existing: DataFrame, key: str, ci: bool = False, first_by: str = "id") -> DataFrame:
    """Rows of ``new`` whose key neither ``existing`` nor an earlier row of ``new`` has; ``ci`` ignores case."""
    plain = (lambda c: F.lower(c)) if ci else (lambda c: c)
    rows = new.withColumn("__key", plain(F.col(key)))
    fresh = rows.join(existing.select(plain(F.col(key)).alias("__key")).distinct(), "__key", "left_anti")
    # The smallest row of a key by a mergeable minimum: copies of one key collapse before the shuffle.
    first = fresh.groupBy("__key").agg(F.min(first_by).alias("__first"))
    return fresh.join(first, "__key").where(F.col(first_by) == F.col("__first")).drop("__key", "__first")


EMAIL_FORM = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def sign_up_rules() -> dict[str, Column]:
    return {
        "full_name": F.length(F.trim("full_name")) >= 2,
        "email": F.regexp_like("email", F.lit(EMAIL_FORM)),
        "password": F.col("password_len") >= 8,
        "confirm": F.col("confirm_len") == F.col("password_len"),
        "terms": F.col("terms"),
    }


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with the names of the rules that each row breaks; a rule that is null is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def patch(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``df`` with the non-null columns of ``patches`` put over rows of the same key."""
    changed = [c for c in patches.columns if c != key]
    over = patches.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in changed])
    return df.join(over, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])


def coerce_model(c: Column) -> Column:
    return F.when(c.isin("crnn", "transformer"), c).otherwise("crnn")


#: Rows of a hash bucket in which ids are counted.
BUCKET_ROWS, MIN_BUCKETS = 250_000, 64


def with_ids(df: DataFrame, start: int, order: str, buckets: int | None = None) -> DataFrame:
    """Ids from ``start`` + 1 without gaps, counted inside hash buckets of ``order`` and along the buckets: no task sees all rows.

    There are as many buckets as the rows need, unless given.
    """
    buckets = buckets or max(MIN_BUCKETS, df.count() // BUCKET_ROWS)
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__bucket", before.alias("__before")))  # one row a bucket
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(order))
    return placed.join(starts, "__bucket").withColumn("id", F.lit(start) + F.col("__before") + within).drop("__bucket", "__before")


def append_recognitions(uploads: DataFrame, results: DataFrame, documents_path: str, recognitions_path: str, key: str = "landing_name", batch: int | str | None = None) -> None:
    """One document and one recognition row for each upload, tied by a key that needs no counter.

    With ``batch`` both tables get the rows under that number in place of what it held, so a batch that is repeated, after a failure
    between the two writes too, adds nothing twice; documents and recognitions of a number belong together.
    """
    keyed = uploads.withColumn("id", F.xxhash64(key))
    documents = keyed.select("id", F.col("name").alias("original_filename"), F.col(key).alias("saved_path"), "uploaded_at")
    rows = results.join(keyed.select(key, F.col("id").alias("document_id")).hint("merge"), key).drop(key).withColumn("id", F.col("document_id"))
    for table, path in ((documents, documents_path), (rows, recognitions_path)):
        if batch is None:
            table.write.mode("append").parquet(path)
        else:
            table.write.mode("overwrite").parquet(f"{path}/batch={batch}")
