"""Tables of the library derived from the driver's tables, in Spark and as DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_W = 1240
#: Types that browsers name for uploads; one has none.
MIME_TYPES = ("image/png", "application/octet-stream", "application/pdf", None, "text/plain")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECOGNIZED = """
SELECT d.doc_id AS id, d.doc_id AS document_id, e.user_id,
  CASE WHEN d.doc_id % 2 = 0 THEN 'crnn' ELSE 'transformer' END AS model_used,
  (d.doc_id % 7 = 0) AS model_simulated, d.text,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(d.n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence,
  e.value AS processing_time_ms,
  concat(d.source, '_', CAST(d.doc_id AS VARCHAR(20)), CASE WHEN d.doc_id % 3 = 0 THEN '.pdf' ELSE '.png' END) AS file_name,
  CASE WHEN d.doc_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS file_type,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE concat('data:image/jpeg;base64,', d.text) END AS thumbnail,
  length(replace(d.text, chr(10), '')) AS num_chars,
  CASE WHEN l.quality = 0 THEN 'failed' ELSE 'completed' END AS status,
  e.ts AS created_at
FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id * 5 LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""


def recognized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RECOGNIZED, documents=load(spark, sf_dir, "documents"), events=load(spark, sf_dir, "events"), labels=load(spark, sf_dir, "labels"))


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose upload is known; every fifth has no name."""
    d = load(spark, sf_dir, "documents")
    return d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("original_filename"))


_BOX_COLUMNS = """page_id, line_no, text,
  CASE WHEN page_id % 2 = 1 AND line_no % 2 = 1 THEN 700 ELSE 40 END AS x,
  CASE WHEN page_id % 2 = 1 THEN CAST(floor(line_no / 2.0) AS INT) * 48 + (line_no % 2) * 3 ELSE line_no * 48 END AS y,
  least(500, 8 * length(text)) AS w, 18 + line_no % 5 AS h"""


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return spark.sql(f"SELECT {_BOX_COLUMNS} FROM {{r}}", r=lines)


def ctc_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("at", "prob"))
    return flat.select("sample_id", F.floor(F.col("at") / 8).cast("int").alias("t"), (F.col("at") % 8).alias("k"), "prob")


_PAIRS = """
SELECT item_id AS sample_id, s.system, t AS truth,
  CASE WHEN s.system = 'crnn' THEN replace(t, 'th', 't') WHEN item_id % 4 = 0 THEN replace(t, ' on', ' in') ELSE t END AS pred
FROM (SELECT item_id, text AS t FROM {benchmark}) b CROSS JOIN (VALUES ('crnn'), ('transformer')) AS s(system)
"""


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts; two systems with errors of their own, which are of ASCII letters, so that edits in bytes are edits in characters."""
    return spark.sql(_PAIRS, benchmark=load(spark, sf_dir, "benchmark"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    n = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return c.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text",
        F.when(F.col("turn") % 5 == 4, 0).otherwise(F.size(F.split("text", "\n"))).alias("num_lines"), n.alias("num_chars"),
        ((n % 100).cast("double") / 100).alias("avg_confidence"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("word_"), "role")).otherwise(F.concat(F.lit("char_"), "role")).alias("engine"),
    )


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph for each character of a conversation's turns but ASCII white space, 10 px apart and 8 px wide."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("line_no"), F.regexp_replace("text", r"[\x00-\x20]", " ").alias("t"))
    g = c.select("page_id", "line_no", F.posexplode(F.split("t", "")).alias("glyph_no", "glyph")).where("glyph <> ' ' AND glyph <> ''")
    return g.select(
        "page_id", "line_no", "glyph_no", "glyph", (F.lit(40) + F.col("glyph_no") * 10).alias("x"), (F.col("line_no") * 48 + F.col("glyph_no") % 3).alias("y"),
        F.lit(8).alias("w"), F.lit(18).alias("h"), ((F.col("glyph_no") % 50 + 50).cast("double") / 100).alias("confidence"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).unionAll(load(spark, sf_dir, "pages").select((F.col("page_id") * 3 + 1).alias("k")))
    ext = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".pdf", ".tiff", ".bmp", ".exe", ""))), (F.col("k") % 7 + 1).cast("int"))
    return d.select(F.concat(F.lit("scan"), F.col("k").cast("string"), ext).alias("name"), (F.col("k") * 1000003 % 41943040).alias("n_bytes"), F.when(F.col("k") % 11 == 0, F.lit("%PDF-1.7")).otherwise("image").cast("binary").alias("head"), F.element_at(F.array(*map(F.lit, MIME_TYPES)), (F.col("k") % 5 + 1).cast("int")).alias("mime_type"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    mail = F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com"))
    return u.select("id", F.concat(F.lit("User "), F.col("id").cast("string")).alias("full_name"), F.when(F.col("id") % 5 == 0, F.upper(mail)).otherwise(mail).alias("email"), F.when(F.col("id") % 3 == 0, "Admin").otherwise("Student").alias("role"))


def sign_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_name")
    n = F.col("id") % 997
    mail = F.when(F.col("id") % 17 == 0, F.concat(F.lit("user"), n.cast("string"))).otherwise(F.concat(F.lit("user"), n.cast("string"), F.lit("@example.com")))
    return c.select("id", F.when(F.col("id") % 19 == 0, "X").otherwise(F.col("c_name")).alias("full_name"), mail.alias("email"), (F.col("id") % 13).cast("int").alias("password_len"), F.when(F.col("id") % 23 == 0, 0).otherwise(F.col("id") % 13).cast("int").alias("confirm_len"), (F.col("id") % 29 != 0).alias("terms"))


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads of their customers: several years, and months without any."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def class_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"))


#: The same tables for DuckDB.
DUCK = {
    "recognized_texts": _RECOGNIZED.format(documents="documents", events="events", labels="labels"),
    "document_images": "SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN concat('scan_', doc_id, '.png') END AS original_filename FROM documents WHERE doc_id % 4 <> 0",
    "line_boxes": f"SELECT {_BOX_COLUMNS} FROM (SELECT doc_id AS page_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents) r",
    "ctc_steps": "SELECT vec_id AS sample_id, CAST(floor(i / 8.0) AS INT) AS t, (i % 8)::INT AS k, embedding[i + 1] AS prob FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)",
    "eval_pairs": _PAIRS.format(benchmark="benchmark"),
    "doc_pages": """SELECT conv_id AS doc_id, (turn + 1)::INT AS page, text, CASE WHEN turn % 5 = 4 THEN 0 ELSE len(string_split(text, chr(10))) END AS num_lines,
        length(replace(text, chr(10), '')) AS num_chars, (length(replace(text, chr(10), '')) % 100)::DOUBLE / 100 AS avg_confidence,
        CASE WHEN conv_id % 2 = 0 THEN concat('word_', role) ELSE concat('char_', role) END AS engine FROM conversations""",
    "glyphs": """SELECT page_id, line_no, glyph_no, glyph, 40 + glyph_no * 10 AS x, line_no * 48 + glyph_no % 3 AS y, 8 AS w, 18 AS h, (glyph_no % 50 + 50)::DOUBLE / 100 AS confidence
        FROM (SELECT conv_id AS page_id, turn::INT AS line_no, unnest(range(length(t)))::INT AS glyph_no, unnest(string_split(t, '')) AS glyph FROM (SELECT *, regexp_replace(text, '[\x00-\x20]', ' ', 'g') AS t FROM conversations) WHERE t <> '') WHERE glyph <> ' '""",
    "uploads": f"""SELECT concat('scan', k, list_extract(['.png', '.JPG', '.pdf', '.tiff', '.bmp', '.exe', ''], (k % 7 + 1)::INT)) AS name, k * 1000003 % 41943040 AS n_bytes,
        CASE WHEN k % 11 = 0 THEN '%PDF-1.7' ELSE 'image' END AS head, list_extract([{", ".join("NULL" if m is None else f"'{m}'" for m in MIME_TYPES)}], (k % 5 + 1)::INT) AS mime_type FROM (SELECT doc_id AS k FROM documents UNION ALL SELECT page_id * 3 + 1 FROM pages)""",
    "users": "SELECT id, concat('User ', id) AS full_name, CASE WHEN id % 5 = 0 THEN upper(concat('user', id, '@example.com')) ELSE concat('user', id, '@example.com') END AS email, CASE WHEN id % 3 = 0 THEN 'Admin' ELSE 'Student' END AS role FROM (SELECT DISTINCT user_id AS id FROM events)",
    "sign_ups": """SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 19 = 0 THEN 'X' ELSE c_name END AS full_name,
        CASE WHEN c_custkey % 17 = 0 THEN concat('user', c_custkey % 997) ELSE concat('user', c_custkey % 997, '@example.com') END AS email,
        (c_custkey % 13)::INT AS password_len, CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE c_custkey % 13 END::INT AS confirm_len, c_custkey % 29 <> 0 AS terms FROM customer""",
    "order_history": "SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT AS user_id, o_orderdate::TIMESTAMP AS created_at FROM orders",
    "class_samples": "SELECT vec_id AS sample_id, label::VARCHAR AS label FROM embeddings",
}


def duck(query: str) -> str:
    """A DuckDB query with the derived tables that it names (in braces) put before it."""
    used = [n for n in DUCK if f"{{{n}}}" in query]
    for n in used:
        query = query.replace(f"{{{n}}}", n)
    return ("WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in used) + "\n" if used else "") + query
