"""Recognition history: search, filter, sort, page, project, look up, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.operators.ranking import ranged, runs_of
from glyphlake.sources.shared import stored

MODELS, FILE_TYPES, STATUSES = ("crnn", "transformer"), ("image", "pdf"), ("completed", "failed")
SORT_COLUMNS = {"date": "created_at", "confidence": "confidence", "name": "file_name"}
MAX_PAGE = 100


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value if allowed, else the first allowed one."""
    return F.when(c.isin(*allowed), c).otherwise(allowed[0])


def history_items(df: DataFrame) -> DataFrame:
    """The list view of a row: nulls and values out of range replaced."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        "user_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.nullif("file_name", F.lit("")), F.lit("unknown")).alias("file_name"),
        one_of(F.col("model_used"), MODELS).alias("model"),
        one_of(F.col("file_type"), FILE_TYPES).alias("file_type"),
        one_of(F.col("status"), STATUSES).alias("status"),
        "num_chars",
        "processing_time_ms",
        "created_at",
    )


def matches(term: str, literal: bool = False) -> Column:
    """Whether file name or text holds the trimmed term; without ``literal``, % and _ are wildcards."""
    term = term.strip()
    if not term:
        return F.lit(True)
    if literal:
        low = F.lit(term.lower())
        return F.contains(F.lower("file_name"), low) | F.contains(F.lower("text"), low)
    term = term.replace("\\", "\\\\")  # a backslash is a letter like any other, not an escape
    return F.col("file_name").ilike(f"%{term}%") | F.col("text").ilike(f"%{term}%")


def filtered(df: DataFrame, user_id: int | None = None, search: str = "", model: str = "all", status: str = "all", literal: bool = False) -> DataFrame:
    """Rows of a user (all users if None) that pass the filters; rows without a user are seen by none."""
    df = df.where(F.col("user_id").isNotNull() if user_id is None else F.col("user_id") == user_id)
    if model != "all":
        df = df.where(F.col("model_used") == model)
    if status != "all":
        df = df.where(F.col("status") == status)
    return df.where(matches(search, literal)) if search.strip() else df


def order_of(sort_by: str = "date", sort_dir: str = "desc") -> list[Column]:
    """Sort key and id; an unknown key is the date, and only 'asc' ascends."""
    c = F.col(SORT_COLUMNS.get(sort_by, "created_at"))
    return [c.asc(), F.col("id").asc()] if sort_dir == "asc" else [c.desc(), F.col("id").desc()]


def history(
    df: DataFrame, user_id: int | None, search: str = "", model: str = "all", status: str = "all", sort_by: str = "date", sort_dir: str = "desc",
    page: int = 1, page_size: int = 10, literal: bool = False, after: tuple | None = None,
) -> DataFrame:
    """One page of a user's history, or of all users'.

    ``after`` is the last row of the page before, as (sort value, id): the page is then sought behind it, so that each task keeps
    a page of rows however deep it lies, and ``page`` is not used. Without it all rows up to the page pass through one task.
    """
    page, page_size = max(1, page), min(MAX_PAGE, max(1, page_size))
    rows = filtered(df, user_id, search, model, status, literal)
    if after is not None:
        return rows.where(behind(after, sort_by, sort_dir)).orderBy(*order_of(sort_by, sort_dir)).limit(page_size)
    return rows.orderBy(*order_of(sort_by, sort_dir)).offset((page - 1) * page_size).limit(page_size)


def behind(cursor: tuple, sort_by: str = "date", sort_dir: str = "desc") -> Column:
    """Whether a row stands behind a cursor (sort value, id) in the order of ``order_of``, where null is the smallest value."""
    name, (value, last) = SORT_COLUMNS.get(sort_by, "created_at"), cursor
    c, own = F.col(name), F.col("id")
    up = sort_dir == "asc"
    next_id = own > last if up else own < last
    if value is None:
        return (c.isNotNull() | next_id) if up else (c.isNull() & next_id)
    value = F.lit(value)
    further = c > value if up else (c < value) | c.isNull()
    return further | ((c == value) & next_id)


def page_table(df: DataFrame, sort_by: str = "date", sort_dir: str = "desc", by: tuple[str, ...] = ("user_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, runs) for pages of any depth: rows written in the order of their users and of the sort, and how many of each user each range has."""
    rows = ranged(df, list(by), order_of(sort_by, sort_dir), "pages")
    return rows, stored(runs_of(rows, list(by)), "page_runs")


def page_of(table: tuple[DataFrame, DataFrame], page: int = 1, page_size: int = 10, **group) -> DataFrame:
    """One page from a ``page_table``, without counting or skipping rows: the counts of ranges say where it lies, and a filter on that
    place, which prunes files and row groups, reads it."""
    rows, runs = table
    page, page_size = max(1, page), min(MAX_PAGE, max(1, page_size))
    first = (page - 1) * page_size
    for c, value in group.items():
        rows, runs = rows.where(F.col(c).eqNullSafe(F.lit(value))), runs.where(F.col(c).eqNullSafe(F.lit(value)))
    # Of the ranges that hold some row of the page: as many as a page has rows, at most.
    held = runs.where((F.col("before") < first + page_size) & (F.col("before") + F.col("n") > first)).select("first", "before", "n").collect()
    place = F.lit(False)
    for r in held:
        low = r["first"] + max(0, first - r["before"])
        place = place | F.col("__at").between(low, r["first"] + min(r["n"], first + page_size - r["before"]) - 1)
    return rows.where(place).orderBy("__at").drop("__at", "__part")


def history_count(df: DataFrame, user_id: int, **filters) -> DataFrame:
    return filtered(df, user_id, **filters).agg(F.count(F.lit(1)).alias("total"))


def pages_per_user(df: DataFrame, page: int = 1, page_size: int = 10, sort_by: str = "date", sort_dir: str = "desc") -> DataFrame:
    """One page of every user's history in one job, with its place and the user's total."""
    page, page_size = max(1, page), min(MAX_PAGE, max(1, page_size))
    # Ranks up to the end of the page are all that a user needs: Spark drops the others before the shuffle.
    at = Window.partitionBy("user_id").orderBy(*order_of(sort_by, sort_dir))
    last = page * page_size
    return df.where("user_id IS NOT NULL").withColumn("place", F.row_number().over(at)).where(F.col("place") <= last).where(F.col("place") > last - page_size)


def sliced_pages(df: DataFrame, page: int = 1, page_size: int = 10, sort_by: str = "date", sort_dir: str = "desc") -> DataFrame:
    """The client's page of every user's history: a plain slice, of any size, that counts from the end where its bounds are negative."""
    rows = df.where("user_id IS NOT NULL")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order_of(sort_by, sort_dir))))
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    first = (page - 1) * page_size
    at = [F.greatest(F.col("total") + k, F.lit(0)) if k < 0 else F.lit(k) for k in (first, first + page_size)]
    return placed.join(totals.hint("merge"), "user_id").where((F.col("place") > at[0]) & (F.col("place") <= at[1])).drop("total")


def by_name(df: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """``place`` of each row among its user's, by file name in the order of a locale and not of bytes."""
    name = F.collate("file_name", collation)
    return df.where("user_id IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(name, "id")))


def page_metadata(df: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """Per user: rows in all, pages, first and last row of the page."""
    total = df.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        "user_id",
        "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long").alias("page_count"),
        F.least(F.col("total"), F.lit((page - 1) * page_size + 1)).cast("long").alias("from_row"),
        F.least(F.col("total"), F.lit(page * page_size)).cast("long").alias("to_row"),
    )


def with_users(df: DataFrame, users: DataFrame, required: bool = False) -> DataFrame:
    """Rows with ``full_name`` and ``role`` of their user: null without one or, if a user is ``required``, without the row."""
    known = users.select(F.col("id").alias("user_id"), "full_name", "role")
    return df.join(known, "user_id", "inner" if required else "left")


def results_by_id(df: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows asked for by (id, user_id), with the name of their document; a document's name wins even if null."""
    found = df.join(wanted, ["id", "user_id"])
    names = docs.select(F.col("id").alias("document_id"), "original_filename", F.lit(True).alias("has_document"))
    own = F.coalesce(F.nullif("file_name", F.lit("")), F.lit("unknown"))
    return found.join(names, "document_id", "left").select("id", "user_id", F.when(F.col("has_document"), F.col("original_filename")).otherwise(own).alias("name"), "status")


def not_found(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids asked for that the user does not own."""
    return wanted.join(df.select("id", "user_id"), ["id", "user_id"], "left_anti")


def delete_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows but those named by (id, user_id); another user's rows stay."""
    return df.join(ids.select("id", "user_id"), ["id", "user_id"], "left_anti")


def delete_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_id"), "user_id", "left_anti")


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def retain_newest(df: DataFrame, n: int = 24, by: str = "created_at") -> DataFrame:
    """The newest ``n`` documents; a top-k that each task prepares, so one task sees n rows of each."""
    return df.orderBy(F.desc(by), F.desc("id")).limit(n)


def expired(requests: DataFrame, retained: DataFrame, key: str = "id") -> DataFrame:
    """Requested documents that are no longer retained."""
    return requests.join(retained.select(key), key, "left_anti")


def camel_case(df: DataFrame) -> DataFrame:
    """snake_case columns renamed to camelCase, those of nested structs too."""

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(w.capitalize() for w in rest)

    def renamed(kind):
        from pyspark.sql import types as T

        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(camel(f.name), renamed(f.dataType), f.nullable) for f in kind.fields])
        return T.ArrayType(renamed(kind.elementType), kind.containsNull) if isinstance(kind, T.ArrayType) else kind

    return df.select(*[F.col(f.name).cast(renamed(f.dataType)).alias(camel(f.name)) for f in df.schema.fields])
