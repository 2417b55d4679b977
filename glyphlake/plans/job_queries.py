"""Registered queries of readers, sinks, recognisers and streaming jobs: each writes tables of the driver's rows, runs the job and reads its result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphlake.operators import ingest, recognise
from glyphlake.plans.queries import EXT, ORACLES, QUERIES, query, written
from glyphlake.sources import files, tables
from glyphlake.sources import fixtures as fx
from glyphlake.sources.shared import shared_dir, stored
from glyphlake.streaming import jobs

__all__ = ["ORACLES", "QUERIES"]  # those of the other module, with the ones below added


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/glyphlake/{uuid.uuid4().hex}"


# ---- readers and sinks


@query("SELECT id, document_id, user_id, model_used, model_simulated, text, confidence, processing_time_ms, file_name, file_type, thumbnail, num_chars::INT AS num_chars, 1 AS num_lines, status, created_at FROM {recognized_texts}")
def s1_stored_recognitions(spark, d):
    return tables.read_recognitions(spark, written(spark, d))


@query("SELECT id, original_filename, concat('uploads/', id) AS saved_path FROM {document_images}")
def s2_stored_documents(spark, d):
    path = _folder(spark)
    fx.document_images(spark, d).select("id", "original_filename", F.concat(F.lit("uploads/"), F.col("id").cast("string")).alias("saved_path"), F.lit(None).cast("timestamp_ntz").alias("uploaded_at")).write.parquet(path)
    return tables.read_documents(spark, path).select("id", "original_filename", "saved_path")


@query("SELECT id, full_name, email, role FROM {users}")
def s2_stored_users(spark, d):
    """Users without their password hashes."""
    path = _folder(spark)
    fx.users(spark, d).withColumn("password_hash", F.sha2("email", 256)).write.parquet(path)
    read = tables.read_users(spark, path)
    return read.select([c for c in read.columns if c in ("id", "full_name", "email", "role", "password_hash")])


_UPLOADED = "SELECT concat('scan', doc_id, CASE WHEN doc_id % 6 = 0 THEN '.exe' ELSE '.PNG' END) AS name, coalesce(strlen(text), 0)::BIGINT AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents"


@query(f"SELECT name, n_bytes, md5, CASE WHEN name LIKE '%.exe' THEN 'extension' WHEN n_bytes > 20971520 THEN 'size' END AS reject_reason FROM ({_UPLOADED})")
def s3_uploaded_files(spark, d):
    """Each document as an uploaded file, read back with its bytes and checked."""
    path = _folder(spark)
    docs = fx.load(spark, d, "documents")
    name = F.concat(F.lit("scan"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 == 0, ".exe").otherwise(".PNG"))
    files.write_files(docs, path, name, F.col("text").cast("binary"), spread=True)
    return ingest.checked_uploads(tables.read_uploads(spark, path, deep=True)).select("name", "n_bytes", F.md5("content").alias("md5"), "reject_reason")


def _class_dirs(spark, d) -> str:
    """Samples as images under their class: the bytes are the digits of their number."""
    path = _folder(spark)
    samples = fx.class_samples(spark, d)
    number = F.col("sample_id").cast("string")
    files.write_class_dirs(samples.select(F.concat(F.lit("digit_"), "label").alias("label"), F.concat(number, F.lit(".png")).alias("name"), number.cast("binary").alias("content")), path)
    return path


@query("SELECT concat('digit_', label) AS label, concat(sample_id, '.png') AS name, sample_id::VARCHAR AS content FROM {class_samples} WHERE label::INT < 7")
def s4_class_folders(spark, d):
    """Labels outside of the character set are left out."""
    known = fx.class_samples(spark, d).where("cast(label AS int) < 7").select(F.concat(F.lit("digit_"), "label").alias("label")).distinct()
    return tables.read_class_dirs(spark, _class_dirs(spark, d), known).select("label", "name", F.col("content").cast("string").alias("content"))


@query("SELECT count(*) AS n, count(*) AS n_names, true AS well_formed FROM {uploads}")
def s6_landing_names(spark, d):
    named = fx.uploads(spark, d).select("name", ingest.landing_name(F.col("name")).alias("landing"))
    return named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("landing").alias("n_names"), F.bool_and(F.regexp_like("landing", F.lit("^[0-9a-f]{32}_")) & F.endswith("landing", F.col("name"))).alias("well_formed"))


def _texts(bom: str) -> str:
    return f"SELECT concat(doc_id, '.txt') AS name, coalesce(strlen(text), 0)::BIGINT + {3 if bom else 0} AS n_bytes, md5(concat({bom or repr('')}, coalesce(text, ''))) AS md5 FROM documents"


def _text_files(spark, d, bom: bool):
    path = _folder(spark)
    files.write_text_files(fx.load(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text"), path, bom=bom, spread=True)
    return tables.read_uploads(spark, path, deep=True).select("name", "n_bytes", F.md5("content").alias("md5"))


@query(_texts(""))
def s7_text_files(spark, d):
    return _text_files(spark, d, False)


@query(_texts("chr(65279)"))
def s7_text_files_with_mark(spark, d):
    return _text_files(spark, d, True)


# ---- streams


def _stream_of(spark, d):
    """Recognitions as a stream of the files that ``write_recognitions`` lays out."""
    return spark.readStream.schema(tables.RECOGNITIONS).option("maxFilesPerTrigger", 8).parquet(f"{written(spark, d)}/day=*")


def _ended(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query(f"""SELECT name, n_bytes, CASE WHEN {EXT} NOT IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'pdf') THEN 'extension' WHEN n_bytes > 20971520 THEN 'size' END AS reject_reason FROM {{uploads}}""")
def st1_ingested_uploads(spark, d):
    path = _folder(spark)
    ups = fx.uploads(spark, d).select("name", "n_bytes")
    ups.write.parquet(f"{path}/in")
    _ended(jobs.stream_ingest(spark.readStream.schema(ups.schema).parquet(f"{path}/in"), f"{path}/ok", f"{path}/no", f"{path}/c"))
    good = spark.read.parquet(f"{path}/ok").select("name", "n_bytes", F.lit(None).cast("string").alias("reject_reason"))
    return good.unionByName(spark.read.parquet(f"{path}/no").select("name", "n_bytes", "reject_reason"))


@query("""SELECT user_id, created_at::DATE::VARCHAR AS day, count(*) AS documents, count(*) FILTER (status = 'completed') AS recognitions, avg(coalesce(confidence, 0.0)) * 100 AS value
FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY ALL""")
def st2_live_trend(spark, d):
    path = _folder(spark)
    trend = jobs.stream_daily_trend(_stream_of(spark, d), "400 days")
    _ended(trend.writeStream.outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/t/batch={number}")).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start())
    return spark.read.parquet(f"{path}/t/batch={jobs.numbered(spark, f'{path}/t', 'batch')[-1]}").withColumn("day", F.col("day").cast("string"))


@query("""SELECT user_id, place, id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS place FROM {recognized_texts} WHERE user_id IS NOT NULL) WHERE place <= 8""")
def st3_live_latest(spark, d):
    path = _folder(spark)
    _ended(jobs.stream_recent(_stream_of(spark, d), path, f"{path}_c", compact_every=2))
    return jobs.read_recent(spark, path).select("user_id", "place", "id", "file_name")


def _retained(spark, d) -> str:
    path = _folder(spark)
    _ended(jobs.stream_retained(_stream_of(spark, d), path, f"{path}_c"))
    return path


@query("SELECT id, created_at FROM {recognized_texts} ORDER BY created_at DESC, id DESC LIMIT 24")
def st3_live_retained(spark, d):
    return jobs.read_retained(spark, _retained(spark, d))


@query("SELECT id FROM {recognized_texts} ORDER BY created_at DESC, id DESC OFFSET 24")
def st3_live_expired(spark, d):
    return jobs.read_expired(spark, _retained(spark, d)).select("id")


# ---- recognisers


class Spelled:
    """A stand-in for a recogniser: it reads a text in capitals, is as sure as the text is long, and fails on texts of a length that 5 divides."""

    def __call__(self, value: str) -> dict:
        if len(value or "") % 5 == 0:
            raise ValueError("unreadable")
        return {"text": value.replace("a", "A"), "confidence": len(value) % 100 / 100}

    def predict_batch(self, values: list[str]) -> list[dict]:
        return [self(v) for v in values]


FAILED = "length(coalesce(text, '')) % 5 = 0"
SPELLED = f"""CASE WHEN {FAILED} THEN '{recognise.FALLBACK_TEXT}' ELSE replace(text, 'a', 'A') END AS text, CASE WHEN {FAILED} THEN 0.0 ELSE (length(text) % 100)::DOUBLE / 100 END AS confidence,
  false AS model_simulated, CASE WHEN {FAILED} THEN 'ValueError: unreadable' END AS error"""
SAMPLE = f"'{recognise.FALLBACK_TEXT}' AS text, {recognise.FALLBACK_CONFIDENCE}::DOUBLE AS confidence, true AS model_simulated, NULL::VARCHAR AS error"


def _pages(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


@query(f"SELECT doc_id, {SPELLED} FROM documents")
def x1_recognised(spark, d):
    return recognise.recognise(_pages(spark, d), Spelled).drop("content")


@query(f"SELECT doc_id, {SAMPLE} FROM documents")
def x2_without_a_model(spark, d):
    return recognise.recognise(_pages(spark, d), None).drop("content")


@query(f"SELECT doc_id, {SPELLED} FROM documents WHERE doc_id % 2 = 0")
def x3_by_the_character_engine(spark, d):
    """No engine for words is there, so that for characters reads."""
    return recognise.recognise(_pages(spark, d).where("doc_id % 2 = 0"), recognise.choose_engine(None, Spelled)).drop("content")


_SPLIT = "SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))) + 1)::INT AS page, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL"


@query(_SPLIT)
def x4_pages_of_files(spark, d):
    return recognise.fan_out_pages(_pages(spark, d).where("content IS NOT NULL"), lambda value: iter(value.split("\n")), "doc_id")


@query(_SPLIT)
def x4_pages_of_texts(spark, d):
    return recognise.text_pages(_pages(spark, d).where("content IS NOT NULL"), "doc_id", "content", "\n").withColumn("page", F.col("page").cast("int"))


@query("""SELECT concat('digit_', label) AS label, concat(sample_id, '.png') AS name, CASE WHEN sample_id % 10 <> 0 THEN reverse(sample_id::VARCHAR) END AS content, CASE WHEN sample_id % 10 = 0 THEN 'ValueError: blank' END AS error FROM {class_samples}""")
def x5_mapped_images(spark, d):
    """A kernel over every image under its class; what it made is written in the same layout, what failed is named."""

    def kernel(content: bytes) -> bytes:
        if content.endswith(b"0"):
            raise ValueError("blank")
        return content[::-1]

    done = stored(recognise.map_directory(tables.read_class_dirs(spark, _class_dirs(spark, d)), kernel), "mapped")  # read again for names, failures and files
    path = _folder(spark)
    files.write_class_dirs(done, path)
    made = tables.read_class_dirs(spark, path).select("label", "name", F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("error"))
    return made.unionByName(done.where("error IS NOT NULL").select("label", "name", F.col("content").cast("string").alias("content"), "error"))


@query(f"SELECT doc_id, {SPELLED}, 'crnn' AS model FROM documents UNION ALL SELECT doc_id, {SAMPLE}, 'transformer' FROM documents")
def x6_all_models(spark, d):
    return recognise.run_models(_pages(spark, d), {"crnn": Spelled, "transformer": None}).drop("content")
