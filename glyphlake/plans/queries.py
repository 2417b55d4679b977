"""Registered queries over the derived tables, each with the DuckDB SQL that checks it where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.functions import script, text
from glyphlake.operators import dashboard, dataset, history, ingest, layout, quantiles, rollup, scoring, search_index
from glyphlake.sources import fixtures as fx
from glyphlake.sources import rewrites
from glyphlake.sources.shared import shared_dir
from glyphlake.sources.tables import RECOGNITIONS, models_df, read_recognitions, write_recognitions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, and the SQL for it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.duck(sql)
        return f

    return add


def _with(*parts: str, body: str) -> str:
    """Parts and fixtures in one WITH."""
    own = ", ".join(parts)
    names = [n for n in fx.DUCK if f"{{{n}}}" in " ".join(parts) + body]
    for n in names:
        own, body = own.replace(f"{{{n}}}", n), body.replace(f"{{{n}}}", n)
    return "WITH " + ", ".join([*(f"{n} AS ({fx.DUCK[n]})" for n in names), own]) + "\n" + body


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


# ---- history

ITEM = """id::VARCHAR AS id, user_id, coalesce(text, '') AS text, coalesce(confidence, 0.0) AS confidence, coalesce(nullif(file_name, ''), 'unknown') AS file_name,
  CASE WHEN model_used IN ('crnn', 'transformer') THEN model_used ELSE 'crnn' END AS model, CASE WHEN file_type IN ('image', 'pdf') THEN file_type ELSE 'image' END AS file_type,
  CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'completed' END AS status, num_chars, processing_time_ms, created_at"""


@query(f"SELECT {ITEM} FROM {{recognized_texts}}")
def p1_history_items(spark, d):
    return history.history_items(fx.recognized_texts(spark, d))


@query("""SELECT id, user_id, file_name, status FROM {recognized_texts}
WHERE model_used = 'crnn' AND status = 'completed' AND (lower(file_name) LIKE '%src1%' OR lower(text) LIKE '%src1%')""")
def p5_history_search(spark, d):
    return history.filtered(fx.recognized_texts(spark, d), search=" SRC1 ", model="crnn", status="completed").select("id", "user_id", "file_name", "status")


@query("SELECT id, user_id FROM {recognized_texts} WHERE lower(file_name) LIKE '%src1_1%' OR lower(text) LIKE '%src1_1%'")
def p5_wildcard_search(spark, d):
    return history.filtered(fx.recognized_texts(spark, d), search="src1_1").select("id", "user_id")


@query("SELECT id, user_id FROM {recognized_texts} WHERE contains(lower(file_name), 'src1_1') OR contains(lower(text), 'src1_1')")
def p6_literal_search(spark, d):
    return history.filtered(fx.recognized_texts(spark, d), search="src1_1", literal=True).select("id", "user_id")


@query("""SELECT r.id, r.user_id, CASE WHEN d.id IS NOT NULL THEN d.original_filename ELSE coalesce(nullif(r.file_name, ''), 'unknown') END AS name, r.status
FROM {recognized_texts} r LEFT JOIN {document_images} d ON d.id = r.document_id""")
def p2_results_by_id(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.results_by_id(rows, fx.document_images(spark, d), rows.select("id", "user_id"))


@query("""SELECT w.id, w.user_id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id FROM {recognized_texts}) w
WHERE NOT EXISTS (SELECT 1 FROM {recognized_texts} r WHERE r.id = w.id AND r.user_id = w.user_id)""")
def p16_not_found(spark, d):
    rows = fx.recognized_texts(spark, d)
    wanted = rows.select("id", F.when(F.col("id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return history.not_found(rows, wanted)


@query("SELECT user_id, count(*) AS total FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id")
def a1_history_count(spark, d):
    return history.filtered(fx.recognized_texts(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


@query("""SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS place FROM {recognized_texts})
WHERE place BETWEEN 11 AND 20""")
def l15_page_per_user(spark, d):
    return history.pages_per_user(fx.recognized_texts(spark, d), page=2, page_size=10).select("user_id", "id", "place")


@query("""SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY confidence ASC NULLS FIRST, id)::INT AS place FROM {recognized_texts})
WHERE place <= 10""")
def o1_page_by_confidence(spark, d):
    return history.pages_per_user(fx.recognized_texts(spark, d), sort_by="confidence", sort_dir="asc").select("user_id", "id", "place")


OWN = "SELECT id, file_name FROM {recognized_texts} WHERE user_id = (SELECT min(user_id) FROM {recognized_texts})"


def _first_user(rows):
    return rows.agg(F.min("user_id")).first()[0]


@query(f"{OWN} ORDER BY file_name, id LIMIT 3 OFFSET 3")
def o2_history_page(spark, d):
    """The second page; bounds out of range are clamped by ``history``."""
    rows = fx.recognized_texts(spark, d)
    return history.history(rows, _first_user(rows), sort_by="name", sort_dir="asc", page=2, page_size=3).select("id", "file_name")


@query(f"{OWN} ORDER BY created_at DESC, id DESC LIMIT 1")
def o2_clamped_page(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.history(rows, _first_user(rows), page=-4, page_size=0).select("id", "file_name")


@query("SELECT id, confidence FROM {recognized_texts} ORDER BY confidence ASC NULLS FIRST, id LIMIT 50 OFFSET 100")
def o2_sought_page(spark, d):
    """The third page of fifty of all users: sought behind the last row of the second, which is sought behind that of the first."""
    rows, last = fx.recognized_texts(spark, d), None
    for _ in range(2):
        page = history.history(rows, None, sort_by="confidence", sort_dir="asc", page_size=50, after=last)
        last = page.select(F.max(F.struct(F.col("confidence").isNotNull(), "confidence", "id")).alias("x")).select("x.confidence", "x.id").first()
        last = None if last["id"] is None else tuple(last)
    return history.history(rows, None, sort_by="confidence", sort_dir="asc", page_size=50, after=last).select("id", "confidence")


@query("SELECT id, user_id FROM {recognized_texts} WHERE user_id IS NOT NULL ORDER BY user_id, created_at DESC, id DESC LIMIT 20 OFFSET 140")
def o2_deep_page(spark, d):
    """Page 8 of all users' rows by user, read at its place in the sorted table."""
    rows = fx.recognized_texts(spark, d).where("user_id IS NOT NULL").select("id", "user_id", "created_at").withColumn("all", F.lit(1))
    rows, runs = history.page_table(rows, by=("all", "user_id"))
    whole = runs.groupBy("all", "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("all").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return history.page_of((rows, whole.withColumn("before", before)), page=8, page_size=20).select("id", "user_id")


SLICED = """SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS place, count(*) OVER (PARTITION BY user_id) AS n
FROM {recognized_texts} WHERE user_id IS NOT NULL)"""


@query(SLICED + " WHERE place <= 1000")
def o3_page_of_any_size(spark, d):
    return history.sliced_pages(fx.recognized_texts(spark, d), page=1, page_size=1000).select("user_id", "id", "place")


@query(SLICED + " WHERE place > 4 AND place <= 8")
def o3_page_of_four(spark, d):
    return history.sliced_pages(fx.recognized_texts(spark, d), page=2, page_size=4).select("user_id", "id", "place")


@query(SLICED + " WHERE place > greatest(n - 6, 0) AND place <= greatest(n - 3, 0)")
def o3_page_before_the_first(spark, d):
    return history.sliced_pages(fx.recognized_texts(spark, d), page=-1, page_size=3).select("user_id", "id", "place")


# In the root locale signs come before digits and digits before letters, and letters go by themselves before their case.
@query("""SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY translate(lower(file_name), '_.', chr(1) || chr(2)), id)::INT AS place FROM {recognized_texts} WHERE user_id IS NOT NULL""")
def o7_locale_name_order(spark, d):
    return history.by_name(fx.recognized_texts(spark, d)).select("user_id", "id", "place")


@query("""SELECT user_id, total, greatest(1, ceil(total / 10.0))::BIGINT AS page_count, least(total, 11)::BIGINT AS from_row, least(total, 20)::BIGINT AS to_row
FROM (SELECT user_id, count(*) AS total FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id)""")
def o5_page_metadata(spark, d):
    return history.page_metadata(fx.recognized_texts(spark, d), page=2)


@query("SELECT id, file_name FROM {recognized_texts} ORDER BY created_at DESC, id DESC LIMIT 6")
def o4_recent_strip(spark, d):
    return history.retain_newest(fx.recognized_texts(spark, d), 6).select("id", "file_name")


@query("SELECT id, created_at FROM {recognized_texts} ORDER BY created_at DESC, id DESC LIMIT 24")
def l14_retained_documents(spark, d):
    return history.retain_newest(fx.recognized_texts(spark, d)).select("id", "created_at")


@query("SELECT id FROM {recognized_texts} WHERE id NOT IN (SELECT id FROM {recognized_texts} ORDER BY created_at DESC, id DESC LIMIT 24)")
def j10_expired_documents(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.expired(rows.select("id"), history.retain_newest(rows))


@query("SELECT id, user_id FROM {recognized_texts} WHERE NOT (status = 'failed')")
def u2_delete_failed(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.delete_ids(rows, rows.where("status = 'failed'")).select("id", "user_id")


@query("SELECT id, user_id FROM {recognized_texts} WHERE user_id % 2 <> 0")
def u3_delete_users(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.delete_users(rows, rows.where("user_id % 2 = 0").select("user_id").distinct()).select("id", "user_id")


def written(spark, d) -> str:
    """Recognitions written as the library lays them out; the folder."""
    path = f"{shared_dir(spark)}/glyphlake/{uuid.uuid4().hex}/recognitions"
    write_recognitions(fx.recognized_texts(spark, d).withColumn("num_lines", F.lit(1)).select([f.name for f in RECOGNITIONS]), path)
    return path


@query("SELECT id, user_id, status FROM {recognized_texts} WHERE NOT (status = 'failed' AND id % 2 = 0)")
def u2_deleted_from_storage(spark, d):
    path = written(spark, d)
    rewrites.delete_stored(spark, path, read_recognitions(spark, path).where("status = 'failed' AND id % 2 = 0").select("id", "user_id"))
    return read_recognitions(spark, path).select("id", "user_id", "status")


@query("SELECT id, user_id FROM {recognized_texts} WHERE user_id % 5 <> 0")
def u3_users_deleted_from_storage(spark, d):
    path = written(spark, d)
    rewrites.delete_stored_users(spark, path, fx.users(spark, d).where("id % 5 = 0").select(F.col("id").alias("user_id")))
    return read_recognitions(spark, path).select("id", "user_id")


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'renamed.png' ELSE file_name END AS file_name, status FROM {recognized_texts}")
def p17_patched_storage(spark, d):
    path = written(spark, d)
    rewrites.patch_stored(spark, path, read_recognitions(spark, path).where("id % 9 = 0").select("id", F.lit("renamed.png").alias("file_name")))
    return read_recognitions(spark, path).select("id", "file_name", "status")


def _searched(spark, d, term, literal=False):
    path = written(spark, d)
    search_index.write_index(spark, path, f"{path}_index")
    return search_index.indexed_search(spark, path, f"{path}_index", term, literal)[0].select("id", "user_id")


_add("p5_indexed_search", lambda s, d: _searched(s, d, " SRC1%_4"), fx.duck("SELECT id, user_id FROM {recognized_texts} WHERE lower(file_name) LIKE '%src1%_4%' OR lower(text) LIKE '%src1%_4%'"))
_add("p6_indexed_literal_search", lambda s, d: _searched(s, d, "src1_1", True), fx.duck("SELECT id, user_id FROM {recognized_texts} WHERE contains(lower(file_name), 'src1_1') OR contains(lower(text), 'src1_1')"))


@query("SELECT user_id, count(*) AS n FROM (SELECT * FROM {recognized_texts} UNION ALL SELECT * FROM {recognized_texts} WHERE status = 'failed') GROUP BY user_id")
def u1_append_history(spark, d):
    rows = fx.recognized_texts(spark, d)
    return history.append(rows, rows.where("status = 'failed'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT id AS "id", document_id AS "documentId", file_name AS "fileName", num_chars AS "numChars" FROM {recognized_texts}')
def p3_camel_case(spark, d):
    return history.camel_case(fx.recognized_texts(spark, d).select("id", "document_id", "file_name", "num_chars"))


@query("""SELECT id, to_json(struct_pack("pageResults" := [struct_pack("pageNumber" := 1, "numChars" := num_chars)], "docInfo" := struct_pack("documentId" := document_id))) AS json FROM {recognized_texts}""")
def p3_camel_case_nested(spark, d):
    page = F.struct(F.lit(1).alias("page_number"), F.col("num_chars").alias("num_chars"))
    nested = fx.recognized_texts(spark, d).select("id", F.array(page).alias("page_results"), F.struct("document_id").alias("doc_info"))
    return history.camel_case(nested).select("id", F.to_json(F.struct("pageResults", "docInfo")).alias("json"))


# ---- dashboard


@query("""SELECT user_id, count(*) AS documents, count(*) FILTER (status = 'completed') AS recognitions,
  coalesce(avg(coalesce(confidence, 0.0)) FILTER (status = 'completed'), 0.0) * 100 AS avg_confidence, sum(coalesce(num_chars, 0))::BIGINT AS characters,
  sum(length(coalesce(thumbnail, '')))::BIGINT * 0.75::DOUBLE AS storage_used, sum(length(coalesce(thumbnail, '')))::BIGINT * 0.75::DOUBLE / 10737418240 * 100 AS storage_percent
FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id""")
def a2_dashboard_kpis(spark, d):
    return dashboard.dashboard_kpis(fx.recognized_texts(spark, d))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (status = 'completed') > 0 THEN avg(coalesce(confidence, 0.0)) ELSE 0.0 END * 100 AS avg_confidence
FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id""")
def a4_client_confidence(spark, d):
    return dashboard.client_confidence(fx.recognized_texts(spark, d))


@query("""SELECT user_id, created_at::DATE::VARCHAR AS day, strftime(min(created_at), '%b %-d') AS label, avg(coalesce(confidence, 0.0)) * 100 AS value, min(created_at) AS first_at
FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id, created_at::DATE""")
def a7_confidence_trend(spark, d):
    return dashboard.confidence_trend(fx.recognized_texts(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("""SELECT user_id, strftime(created_at, '%b %-d') AS label, avg(coalesce(confidence, 0.0)) * 100 AS value, min(created_at) AS first_at
FROM {recognized_texts} WHERE user_id IS NOT NULL GROUP BY user_id, strftime(created_at, '%b %-d')""")
def a7_trend_by_label(spark, d):
    return dashboard.confidence_trend(fx.recognized_texts(spark, d), compat=True)


@query("""SELECT user_id, label, value FROM (SELECT user_id, strftime(created_at, '%b %-d') AS label, avg(coalesce(confidence, 0.0)) * 100 AS value FROM {recognized_texts} GROUP BY ALL)
UNION ALL SELECT id, 'Today', 0.0 FROM {users} WHERE id NOT IN (SELECT user_id FROM {recognized_texts})""")
def a7_trend_of_all_users(spark, d):
    return dashboard.with_empty_point(dashboard.confidence_trend(fx.recognized_texts(spark, d), compat=True), fx.users(spark, d).select(F.col("id").alias("user_id")))


MONTHS = """WITH counted AS (SELECT user_id, date_trunc('month', created_at)::DATE AS month, count(*) AS documents FROM {0} WHERE user_id IS NOT NULL GROUP BY ALL),
every AS (SELECT user_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM counted GROUP BY user_id)
SELECT user_id, strftime(month, '%Y-%m') AS month, documents, (documents - before) * 100.0::DOUBLE / nullif(before, 0) AS delta_percent FROM (
  SELECT user_id, month, documents, lag(documents) OVER (PARTITION BY user_id ORDER BY month) AS before FROM (
    SELECT user_id, month, coalesce(documents, 0) AS documents FROM every LEFT JOIN counted USING (user_id, month)))"""
_add("a8_monthly_delta", lambda s, d: dashboard.monthly_delta(fx.recognized_texts(s, d)), MONTHS.format(f"({fx.DUCK['recognized_texts']})"))
_add("a8_monthly_delta_with_gaps", lambda s, d: dashboard.monthly_delta(fx.order_history(s, d)), MONTHS.format(f"({fx.DUCK['order_history']})"))


@query("""SELECT user_id, place, concat('activity_', id) AS activity_id,
  concat('Recognized "', file_name, '" with ', t // 10, '.', t % 10, '% confidence') AS message, created_at
FROM (SELECT *, floor(coalesce(confidence, 0.0) * 1000 + 0.5)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS place FROM {recognized_texts})
WHERE place <= 8""")
def l13_recent_activity(spark, d):
    return dashboard.recent_activity(fx.recognized_texts(spark, d))


@query("""SELECT m.model_id, m.name, CASE WHEN l.model_used IS NOT NULL THEN 'active' ELSE 'degraded' END AS status
FROM (VALUES ('crnn', 'CRNN'), ('transformer', 'Transformer OCR')) m(model_id, name) LEFT JOIN (SELECT DISTINCT model_used FROM {recognized_texts} WHERE NOT model_simulated) l ON l.model_used = m.model_id""")
def p19_model_status(spark, d):
    loaded = fx.recognized_texts(spark, d).where("NOT model_simulated").select(F.col("model_used").alias("model_id")).distinct()
    return dashboard.model_status(models_df(spark), loaded)


@query("""SELECT CASE WHEN count(*) > 0 THEN 'operational' ELSE 'degraded' END AS status, CASE WHEN count(*) > 0 THEN 'All systems operational' ELSE 'Running in mock-inference mode — no trained model weights are loaded' END AS message, true AS checked
FROM {recognized_texts} WHERE NOT model_simulated AND model_used IN ('crnn', 'transformer')""")
def a18_health(spark, d):
    return dashboard.health_rollup(p19_model_status(spark, d)).select("status", "message", (F.col("checked_at") <= F.current_timestamp()).alias("checked"))


@query("""SELECT u.id, CASE WHEN u.id % 4 <> 0 THEN h.status ELSE 'down' END AS status, CASE WHEN u.id % 4 <> 0 THEN h.message ELSE 'Could not reach the health endpoint.' END AS message
FROM {users} u, (SELECT CASE WHEN count(*) > 0 THEN 'operational' ELSE 'degraded' END AS status, CASE WHEN count(*) > 0 THEN 'All systems operational' ELSE 'Running in mock-inference mode — no trained model weights are loaded' END AS message
  FROM {recognized_texts} WHERE NOT model_simulated AND model_used IN ('crnn', 'transformer')) h""")
def a18_client_health(spark, d):
    health = dashboard.health_rollup(p19_model_status(spark, d)).select(F.struct("status", "message").alias("h"), F.lit(1).alias("one"))
    seen = fx.users(spark, d).select("id", F.lit(1).alias("one")).join(F.broadcast(health), "one").select("id", "h.*")  # one row
    return dashboard.client_health(seen, F.col("id") % 4 != 0)


# ---- uploads and sign-ups

EXT = r"lower(regexp_extract(name, '\.([^.]*)$', 1))"


@query(f"""SELECT name, n_bytes, {EXT} AS ext, CASE WHEN {EXT} NOT IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'pdf') THEN 'extension' WHEN n_bytes > 20971520 THEN 'size' END AS reject_reason FROM {{uploads}}""")
def p9_validated_uploads(spark, d):
    return ingest.checked_uploads(fx.uploads(spark, d).drop("head", "mime_type"))


@query(f"""SELECT name, n_bytes, mime_type, {EXT} AS ext FROM {{uploads}}
WHERE ({EXT} IN ('jpg', 'jpeg', 'png', 'pdf') OR mime_type IN ('image/jpeg', 'image/png', 'image/jpg', 'application/pdf')) AND n_bytes <= 20971520""")
def p11_client_accepted(spark, d):
    return ingest.validate_uploads(fx.uploads(spark, d).drop("head"), ingest.CLIENT)[0]


@query("SELECT name, lower(name) LIKE '%.pdf' OR head LIKE '\\%PDF-%' ESCAPE '\\' AS is_pdf FROM {uploads}")
def p13_pdf_sniff(spark, d):
    return fx.uploads(spark, d).select("name", ingest.is_pdf(F.col("name"), F.col("head")).alias("is_pdf"))


@query("SELECT id, CASE WHEN id % 3 = 1 AND model_used = 'transformer' THEN 'transformer' ELSE 'crnn' END AS model FROM {recognized_texts}")
def p12_coerced_model(spark, d):
    asked = F.when(F.col("id") % 3 == 0, F.upper("model_used")).when(F.col("id") % 3 == 1, F.col("model_used"))  # known, unknown and missing names
    return fx.recognized_texts(spark, d).select("id", ingest.coerce_model(asked).alias("model"))


@query("""SELECT min(id) AS id, email FROM {sign_ups} s WHERE email NOT IN (SELECT email FROM {users}) GROUP BY email""")
def j3_admitted_sign_ups(spark, d):
    return ingest.admit_new_keys(fx.sign_ups(spark, d), fx.users(spark, d), "email").select("id", "email")


@query("""SELECT min(id) AS id, lower(email) AS email FROM {sign_ups} s WHERE lower(email) NOT IN (SELECT lower(email) FROM {users}) GROUP BY lower(email)""")
def j3_admitted_any_case(spark, d):
    return ingest.admit_new_keys(fx.sign_ups(spark, d), fx.users(spark, d), "email", ci=True).select("id", F.lower("email").alias("email"))


@query(r"""SELECT id, concat_ws(',', CASE WHEN length(trim(full_name)) < 2 THEN 'full_name' END, CASE WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' END,
  CASE WHEN password_len < 8 THEN 'password' END, CASE WHEN confirm_len <> password_len THEN 'confirm' END, CASE WHEN NOT terms THEN 'terms' END) AS violations FROM {sign_ups}""")
def p18_sign_up_rules(spark, d):
    return ingest.check_rules(fx.sign_ups(spark, d), ingest.sign_up_rules()).select("id", F.concat_ws(",", "violations").alias("violations"))


@query("SELECT id, full_name, lower(email) AS email, CASE WHEN id % 4 = 0 THEN 'Editor' ELSE role END AS role FROM {users}")
def p17_patched_profiles(spark, d):
    u = fx.users(spark, d)
    patches = u.select("id", F.lower("email").alias("email"), F.when(F.col("id") % 4 == 0, "Editor").alias("role"))
    return ingest.patch(u, patches, "id")


WITH_USER = "SELECT r.id, u.full_name, u.role FROM {recognized_texts} r %s JOIN (SELECT * FROM {users} WHERE id %% 4 <> 1) u ON u.id = r.user_id"


@query(WITH_USER % "LEFT")
def j2_recognitions_with_user(spark, d):
    return history.with_users(fx.recognized_texts(spark, d), fx.users(spark, d).where("id % 4 <> 1")).select("id", "full_name", "role")


@query(WITH_USER % "INNER")
def j2_recognitions_of_known_users(spark, d):
    return history.with_users(fx.recognized_texts(spark, d), fx.users(spark, d).where("id % 4 <> 1"), required=True).select("id", "full_name", "role")


@query("SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, count(DISTINCT id) AS n_ids FROM (SELECT row_number() OVER () + 1000 AS id FROM {sign_ups})")
def s5_surrogate_ids(spark, d):
    rows = ingest.with_ids(fx.sign_ups(spark, d).withColumnRenamed("id", "custkey"), 1000, "custkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("n_ids"))


# ---- layout

DRIFTING = """drifting AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY y, x, line_no ROWS UNBOUNDED PRECEDING)::INT AS row_no FROM (
  SELECT *, CASE WHEN median_h > 0 AND y - lag(y) OVER (PARTITION BY page_id ORDER BY y, x, line_no) > 1.5 * median_h THEN 1 ELSE 0 END AS step
  FROM (SELECT *, median(h) OVER (PARTITION BY page_id) AS median_h FROM {line_boxes})))"""


_add("l1_rows_drifting", lambda s, d: layout.rows_drifting(fx.line_boxes(s, d)).select("page_id", "line_no", "row_no"), _with(DRIFTING, body="SELECT page_id, line_no, row_no FROM drifting"))

# A row's first box decides, so the SQL folds a page's sorted y values as well.
FOLDED = """sorted AS (SELECT page_id, list(struct_pack(y := y, x := x, line_no := line_no, text := text, w := w, h := h) ORDER BY y, x, line_no) AS boxes FROM {line_boxes} GROUP BY page_id),
folded AS (SELECT page_id, boxes, list_reduce(list_transform(boxes, lambda b: {'anchor': b.y, 'rows': [0]}),
  lambda a, b: CASE WHEN abs(b.anchor - a.anchor) > 15 THEN {'anchor': b.anchor, 'rows': list_append(a.rows, a.rows[-1] + 1)} ELSE {'anchor': a.anchor, 'rows': list_append(a.rows, a.rows[-1])} END).rows AS rows FROM sorted),
anchored AS (SELECT page_id, b.line_no, b.text, b.x, b.y, b.w, b.h, row_no FROM (SELECT page_id, unnest(boxes) AS b, unnest(rows) AS row_no FROM folded))"""
RANGES = """gaps AS (SELECT *, x + w AS edge, lead(x) OVER (PARTITION BY page_id, row_no ORDER BY x, line_no) - (x + w) AS gap FROM anchored),
usual AS (SELECT page_id, median(gap) FILTER (gap > 0) AS median_gap FROM gaps GROUP BY page_id),
edges AS (SELECT DISTINCT page_id, edge FROM gaps JOIN usual USING (page_id) WHERE gap > greatest(median_gap * 3, 30)),
ends AS (SELECT page_id, edge FROM edges UNION ALL SELECT DISTINCT page_id, 2000 FROM edges),
ranges AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY edge) - 1)::INT AS col, lag(edge, 1, 0) OVER (PARTITION BY page_id ORDER BY edge) AS start_x, edge AS end_x FROM ends)"""
CELLS = """cells AS (SELECT a.*, coalesce((SELECT min(r.col) FROM ranges r WHERE r.page_id = a.page_id AND r.start_x <= a.x AND a.x < r.end_x), (SELECT max(r.col) FROM ranges r WHERE r.page_id = a.page_id)) AS col FROM anchored a)"""


def _rows(s, d):
    return layout.rows_anchored(fx.line_boxes(s, d))


def _cells(s, d):
    rows = _rows(s, d)
    return layout.assign_cells(rows, layout.column_ranges(rows))


_add("l2_rows_anchored", lambda s, d: _rows(s, d).select("page_id", "line_no", "row_no"), _with(FOLDED, body="SELECT page_id, line_no, row_no FROM anchored"))
_add("l3_row_gaps", lambda s, d: layout.row_gaps(_rows(s, d)).select("page_id", "line_no", F.col("gap").cast("double").alias("gap")), _with(FOLDED, RANGES, body="SELECT page_id, line_no, gap::DOUBLE AS gap FROM gaps"))
_add("l4_column_ranges", lambda s, d: layout.column_ranges(_rows(s, d)), _with(FOLDED, RANGES, body="SELECT page_id, col, start_x, end_x FROM ranges"))
_add("j7_boxes_in_columns", lambda s, d: _cells(s, d).select("page_id", "line_no", F.col("col").cast("double").alias("col")), _with(FOLDED, RANGES, CELLS, body="SELECT page_id, line_no, col::DOUBLE AS col FROM cells"))
_add("l10_cell_text", lambda s, d: layout.cell_text(_cells(s, d)), _with(FOLDED, RANGES, CELLS, body="SELECT page_id, row_no, coalesce(col, 0) AS col, string_agg(text, ' ' ORDER BY x, line_no) AS cell FROM cells GROUP BY ALL"))
_add(
    "s8_cell_grid", lambda s, d: layout.cell_grid(_cells(s, d), 3).withColumn("more", F.array_join("more", "|")),
    _with(FOLDED, RANGES, CELLS, body="""SELECT page_id, row_no, max(cell) FILTER (col = 0) AS c0, max(cell) FILTER (col = 1) AS c1, max(cell) FILTER (col = 2) AS c2, string_agg(cell, '|' ORDER BY col) FILTER (col > 2) AS more
FROM (SELECT page_id, row_no, coalesce(col, 0) AS col, string_agg(text, ' ' ORDER BY x, line_no) AS cell FROM cells GROUP BY ALL) GROUP BY ALL"""),
)
_add("a16_page_medians", lambda s, d: layout.page_medians(fx.line_boxes(s, d)), fx.duck("SELECT page_id, median(w) AS median_w, median(h) AS median_h FROM {line_boxes} GROUP BY page_id"))
_add(
    "a17_boundaries", lambda s, d: layout.column_ranges(_rows(s, d)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("end_x")), ",").alias("edges")),
    _with(FOLDED, RANGES, body="SELECT page_id, string_agg(end_x::VARCHAR, ',' ORDER BY end_x) AS edges FROM ranges GROUP BY page_id"),
)
TWO = """firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, row_no ORDER BY x, line_no) AS place, lead(x) OVER (PARTITION BY page_id, row_no ORDER BY x, line_no) - x - w AS gap FROM drifting),
two AS (SELECT page_id, coalesce(bool_or(gap > greatest(median_h * 2, 1240 * 0.2)), false) AS two_columns FROM firsts WHERE place = 1 GROUP BY page_id),
placed AS (SELECT b.*, CASE WHEN two_columns AND x + w / 2.0 >= 620 THEN 1 ELSE 0 END AS col FROM {line_boxes} b JOIN two USING (page_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, col ORDER BY y, x, line_no)::INT AS rank FROM placed)"""
_add("l6_two_column_pages", lambda s, d: layout.two_column_pages(fx.line_boxes(s, d), fx.PAGE_W), _with(DRIFTING, TWO, body="SELECT page_id, two_columns FROM two"))
_add("l8_column_ranks", lambda s, d: layout.detect_columns(fx.line_boxes(s, d), fx.PAGE_W).select("page_id", "line_no", "col", "rank"), _with(DRIFTING, TWO, body="SELECT page_id, line_no, col, rank FROM ranked"))
for _merge, _keys in (("round_robin", "rank, col"), ("column", "col, rank")):
    _add(
        f"l9_reading_order_{_merge}", lambda s, d, m=_merge: layout.reading_order(fx.line_boxes(s, d), fx.PAGE_W, m).select("page_id", "line_no", "place"),
        _with(DRIFTING, TWO, body=f"SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY {_keys})::INT AS place FROM ranked"),
    )
_add(
    "s9_text_layer", lambda s, d: layout.text_layer(fx.line_boxes(s, d), fx.PAGE_W),
    _with(DRIFTING, TWO, body=r"SELECT * FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rank, col)::INT AS place, text, x, y, w, h FROM ranked) WHERE regexp_matches(text, '\S')"),
)
_add(
    "j6_lines_of_boxes", lambda s, d: layout.lines_of_boxes(fx.line_boxes(s, d).select("page_id", "x", "y", "w", "h"), fx.line_boxes(s, d)),
    fx.duck("""SELECT b.page_id, b.x, b.y, b.w, b.h, l.line_text FROM {line_boxes} b
JOIN (SELECT page_id, x, y, w, h, max_by(text, line_no) AS line_text FROM {line_boxes} GROUP BY ALL) l USING (page_id, x, y, w, h)"""),
)


@query(r"SELECT page_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '\S')) AS n_full FROM {line_boxes} GROUP BY page_id")
def s10_parsed_lines(spark, d):
    boxes = fx.line_boxes(spark, d)
    payload = boxes.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.struct("x", "y", "w", "h").alias("box"), "text")))).alias("json"))
    parsed = payload.select("page_id", layout.parse_lines(F.col("json")).alias("lines"))
    return parsed.select("page_id", F.size("lines").cast("long").alias("n_lines"), F.size(layout.boxed_lines(F.col("lines"))).cast("long").alias("n_full"))


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1)::INT AS place, line
FROM (SELECT doc_id, page, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {doc_pages} WHERE page % 3 <> 0)""")
def u4_flattened_lines(spark, d):
    page = F.struct("page", F.when(F.col("page") % 3 != 0, F.split("text", "\n")).alias("lines"))  # some pages have no lines
    documents = fx.doc_pages(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return documents.select("doc_id", F.posexplode(layout.flatten_lines(F.col("pages"))).alias("place", "line"))


# ---- roll-ups


@query("""SELECT page_id, line_no, string_agg(piece, '' ORDER BY glyph_no) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n_glyphs, 0.0::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY page_id, line_no ORDER BY glyph_no) > 0.8 * median(w) OVER (PARTITION BY page_id, line_no) THEN concat(' ', glyph) ELSE glyph END AS piece FROM {glyphs})
GROUP BY page_id, line_no""")
def a14_lines_from_glyphs(spark, d):
    return rollup.lines_from_glyphs(fx.glyphs(spark, d))


@query("SELECT page_id, count(*) AS num_chars, count(DISTINCT line_no) AS num_lines, avg(confidence) AS avg_confidence FROM {glyphs} GROUP BY page_id")
def a15_pages_from_glyphs(spark, d):
    return rollup.pages_from_glyphs(fx.glyphs(spark, d))


@query("""SELECT doc_id AS page_id, string_agg(text, chr(10) ORDER BY page) AS text, count(*) AS num_lines, coalesce(avg(nullif(avg_confidence, 0)), 0.0) AS avg_confidence,
  length(replace(replace(string_agg(text, chr(10) ORDER BY page), chr(10), ''), ' ', ''))::BIGINT AS num_chars FROM {doc_pages} GROUP BY doc_id""")
def a13_pages_from_lines(spark, d):
    lines = fx.doc_pages(spark, d).select(F.col("doc_id").alias("page_id"), F.col("page").alias("line_no"), "text", F.col("avg_confidence").alias("confidence"))
    return rollup.pages_from_lines(lines)


@query("""SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, sum(num_lines)::BIGINT AS num_lines, sum(num_chars)::BIGINT AS num_chars, count(*) AS num_pages, min_by(engine, page) AS engine,
  coalesce(avg(avg_confidence) FILTER (num_lines > 0), 0.0) AS avg_confidence, bool_or(num_lines > 0) AS any_lines, CASE WHEN NOT bool_or(num_lines > 0) THEN 'No text was recognised' END AS error FROM {doc_pages} GROUP BY doc_id""")
def a11_documents_from_pages(spark, d):
    return rollup.documents_from_pages(fx.doc_pages(spark, d))


@query("SELECT doc_id, string_agg(concat('[Page ', page, ']', chr(10), text), chr(10) || chr(10) ORDER BY page) AS text FROM {doc_pages} GROUP BY doc_id")
def a10_headed_text(spark, d):
    return rollup.headed_text(fx.doc_pages(spark, d))


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, coalesce(avg(avg_confidence), 0.0) AS confidence FROM {doc_pages} GROUP BY doc_id")
def a9_pdf_text(spark, d):
    return rollup.pdf_text(fx.doc_pages(spark, d))


BEST = "SELECT sample_id, t, max(prob) AS best, min(k) FILTER (prob = top) AS k FROM (SELECT *, max(prob) OVER (PARTITION BY sample_id, t) AS top FROM {ctc_steps}) GROUP BY sample_id, t"


@query(f"SELECT sample_id, t, best, k FROM ({BEST})")
def f16_best_steps(spark, d):
    return rollup.best_steps(fx.ctc_steps(spark, d))


@query(f"""SELECT sample_id, coalesce(string_agg(k::VARCHAR, ' ' ORDER BY t) FILTER (k <> 7 AND k IS DISTINCT FROM before), '') AS text, avg(best::DOUBLE) AS confidence
FROM (SELECT *, lag(k) OVER (PARTITION BY sample_id ORDER BY t) AS before FROM ({BEST})) GROUP BY sample_id""")
def l12_ctc_decode(spark, d):
    return rollup.ctc_decode(fx.ctc_steps(spark, d), blank=7)


CHARS = ("क", "ख", "ग", "घ", "ङ", "च")  # class 6 has no character


@query(f"""SELECT sample_id, coalesce(string_agg(coalesce(list_extract([{", ".join(f"'{c}'" for c in CHARS)}], k + 1), ''), '' ORDER BY t) FILTER (k <> 7 AND k IS DISTINCT FROM before), '') AS text, avg(best::DOUBLE) AS confidence
FROM (SELECT *, lag(k) OVER (PARTITION BY sample_id ORDER BY t) AS before FROM ({BEST})) GROUP BY sample_id""")
def l12_ctc_decode_charset(spark, d):
    return rollup.ctc_decode(fx.ctc_steps(spark, d), blank=7, charset=dict(enumerate(CHARS)))


# ---- text functions and scripts


@query(r"""SELECT doc_id, length(replace(text, chr(10), '')) AS plain, length(replace(replace(text, chr(10), ''), ' ', '')) AS dense,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\t\n\v\f\r ]'))))::INT END AS n_lines FROM documents""")
def f2_text_counts(spark, d):
    c = F.col("text")
    return fx.load(spark, d, "documents").select("doc_id", text.char_count(c).alias("plain"), text.char_count(c, "dense").alias("dense"), text.line_count(c).alias("n_lines"))


@query(r"""SELECT id, CASE WHEN confidence >= 0.95 THEN 'Excellent' WHEN confidence >= 0.85 THEN 'Good' WHEN confidence >= 0.7 THEN 'Fair' ELSE 'Low' END AS band, regexp_replace(file_name, '\.[^.]+$', '') AS stem FROM {recognized_texts}""")
def f4_bands_and_stems(spark, d):
    return fx.recognized_texts(spark, d).select("id", text.confidence_band(F.col("confidence")).alias("band"), text.strip_ext(F.col("file_name")).alias("stem"))


@query("SELECT id, round(processing_time_ms, 2) AS ms, round(confidence, 4) AS score, round(coalesce(confidence, 0) * 100, 0) AS percent FROM {recognized_texts}")
def f20_rounded(spark, d):
    c = F.col("confidence")
    return fx.recognized_texts(spark, d).select("id", text.milliseconds(F.col("processing_time_ms")).alias("ms"), text.score(c).alias("score"), text.percent(F.coalesce(c, F.lit(0.0)), 0).alias("percent"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def f1_nfc(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", text.nfc(F.col("text")).alias("text"))


@query("SELECT page_id, line_no, x + w AS right_edge, x + w / 2.0::DOUBLE AS centre FROM {line_boxes}")
def f17_box_geometry(spark, d):
    return fx.line_boxes(spark, d).select("page_id", "line_no", text.right_edge(F.col("x"), F.col("w")).alias("right_edge"), text.centre(F.col("x"), F.col("w")).alias("centre"))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in table.items()) + "}"


def _sql_replaced(c: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        c = f"replace({c}, {_sql(k)}, {_sql(v)})"
    return c


def _sql_moved(c: str, marks: str, pattern: str, order: str) -> str:
    return f"regexp_replace({c}, {_sql(pattern)}, {_sql(order.replace('$', chr(92)))}, 'g')"


def _sql_text(c: str) -> str:
    """The SQL of ``preeti_to_unicode`` behind the key map."""
    c = _sql_replaced(_sql_moved(_sql_replaced(c, {f"{script.HALANT}ा": ""}), *script.TAIL_OF_TWO), script.TWO_STROKES)
    c = _sql_moved(_sql_replaced(_sql_moved(c, *script.TAIL_OF_ONE), script.WITH_TAIL), *script.SHORT_I)
    for move in script.REPH:
        c = _sql_moved(c, *move)
    c = _sql_replaced(c, {"{": f"र{script.HALANT}"})
    for move in (*script.SIGNS, script.NASAL_LAST):
        c = _sql_moved(c, *move)
    c = f"regexp_replace({_sql_replaced(c, {2 * sign: sign for sign in script.ONCE})}, '^ः', ':')"
    return _sql_replaced(c, script.COMPOSED)


_KEYED = f"array_to_string(list_transform(string_split(text, ''), lambda c: coalesce({_sql_map(script.KEY_TO_TEXT)}[c], c)), '')"
_add("f10_preeti_to_unicode", lambda s, d: fx.load(s, d, "documents").select("doc_id", script.preeti_to_unicode(F.col("text")).alias("converted")), f"SELECT doc_id, {_sql_text(_KEYED)} AS converted FROM documents")
ROMAN_UNIT = f"(?s)MM|M|(?:{script.CONSONANT})(?:{script.VOWEL})?|{script.VOWEL}|."
_UNITS = f"regexp_extract_all(text, {_sql(ROMAN_UNIT)})"
_HEAD = f"regexp_extract(u, {_sql('^(' + script.CONSONANT + ')')}, 1)"
_LETTERS, _ALONE = _sql_map(script.ROMAN_CONSONANTS), _sql_map({k: v[0] for k, v in script.ROMAN_VOWELS.items()} | script.NASALS)
_SIGNS = _sql_map({k: v[1] for k, v in script.ROMAN_VOWELS.items()})
_ROMAN = f"""SELECT doc_id, array_to_string(list_transform(units, lambda u, i: CASE WHEN {_HEAD} <> '' THEN concat(CASE WHEN i > 1 AND {_LETTERS}[units[i - 1]] IS NOT NULL THEN '{script.HALANT}' ELSE '' END,
  {_LETTERS}[{_HEAD}], coalesce({_SIGNS}[substr(u, length({_HEAD}) + 1)], '')) ELSE coalesce({_ALONE}[u], u) END), '') AS converted FROM (SELECT doc_id, {_UNITS} AS units FROM documents)"""
_add("f12_roman_to_devanagari", lambda s, d: fx.load(s, d, "documents").select("doc_id", script.roman_to_devanagari(F.col("text")).alias("converted")), _ROMAN)


def _sql_keys(c: str) -> str:
    """The SQL of ``unicode_to_preeti`` over a text expression."""
    above, table = f"regexp_matches(s, '^र{script.HALANT}[{script.CONSONANTS}]')", _sql_map(script.TEXT_TO_KEY)
    typed = f"array_to_string(list_transform(regexp_extract_all(replace(CASE WHEN {above} THEN substr(s, 3) ELSE s END, 'ि', ''), '(?s).'), lambda c: coalesce({table}[c], c)), '')"
    whole = f"concat(CASE WHEN contains(s, 'ि') THEN 'l' ELSE '' END, {typed}, CASE WHEN {above} THEN '{{' ELSE '' END)"
    return f"array_to_string(list_transform(regexp_extract_all({c}, {_sql(script.SYLLABLE)}), lambda s: CASE WHEN regexp_matches(s, '^[{script.CONSONANTS}]') THEN {whole} ELSE coalesce({table}[s], s) END), '')"


_add("f11_unicode_to_preeti", lambda s, d: fx.load(s, d, "documents").select("doc_id", script.unicode_to_preeti(script.roman_to_devanagari(F.col("text"))).alias("typed")), f"SELECT doc_id, {_sql_keys('converted')} AS typed FROM ({_ROMAN})")
_PART = f"regexp_extract_all(x, {_sql(ROMAN_UNIT)})"
_WORD = f"""array_to_string(list_transform({_PART}, lambda u, i: CASE WHEN {_HEAD} <> '' THEN concat(CASE WHEN i > 1 AND {_LETTERS}[{_PART}[i - 1]] IS NOT NULL THEN '{script.HALANT}' ELSE '' END,
  {_LETTERS}[{_HEAD}], coalesce({_SIGNS}[substr(u, length({_HEAD}) + 1)], '')) ELSE coalesce({_ALONE}[u], u) END), '')"""
_add(
    "f13_roman_runs", lambda s, d: fx.load(s, d, "documents").select("doc_id", script.roman_runs(F.col("text")).alias("converted")),
    f"""SELECT doc_id, array_to_string(list_transform(parts, lambda x, k: CASE WHEN regexp_matches(x, '^[A-Za-z]') AND regexp_matches(coalesce(parts[k + 1], ''), '^[ \\n]') THEN {_WORD} ELSE x END), '') AS converted
FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]+') AS parts FROM documents)""",
)
_add(
    "f14_conversion_report", lambda s, d: script.conversion_report(fx.load(s, d, "documents"), "text", "lang"),
    f"""SELECT lang, count(*) AS n_rows, count(*) FILTER (back = text) AS n_round_trip, sum(unmapped)::BIGINT AS n_unmapped, sum(length(done))::BIGINT AS n_chars_out
FROM (SELECT *, {_sql_keys('done')} AS back, len(list_filter(regexp_extract_all(text, '(?s).'), lambda c: {_sql_map(script.KEY_TO_TEXT)}[c] IS NULL)) AS unmapped
  FROM (SELECT lang, text, {_sql_text(_KEYED)} AS done FROM documents)) GROUP BY lang""",
)


@query(f"SELECT sample_id, label, coalesce({_sql_map(script.LABEL_TO_GLYPH)}[concat('digit_', label)], '') AS glyph FROM {{class_samples}}")
def j4_label_glyphs(spark, d):
    return fx.class_samples(spark, d).select("sample_id", "label", script.label_to_glyph(F.concat(F.lit("digit_"), "label")).alias("glyph"))


# ---- scores


@query("SELECT system, count(*) AS samples, count(*) FILTER (pred = truth) AS exact, avg((pred = truth)::INT::DOUBLE) AS accuracy FROM {eval_pairs} GROUP BY system")
def a20_accuracy(spark, d):
    return scoring.accuracy(fx.eval_pairs(spark, d))


def _scripts(name: str, split: str) -> str:
    """Edit scripts in SQL: rows of the distance table folded along the prediction, each row along the truth. A cell is a number:
    edits, then substitutions and deletions in six digits each; of equal edits a pair goes before a deletion, and that before an insertion."""
    each = 10**12
    cell = f"""CASE WHEN a[j[1]] = x.w THEN above.r[j[1]] WHEN above.r[j[1]] // {each} <= least(above.r[j[1] + 1] // {each}, row[-1] // {each}) THEN above.r[j[1]] + {each} + 1000000
      WHEN row[-1] // {each} <= above.r[j[1] + 1] // {each} THEN row[-1] + {each} + 1 ELSE above.r[j[1] + 1] + {each} END"""
    return f"""{name}_parts AS (SELECT sample_id, system, {split.format("truth")} AS a, {split.format("pred")} AS b FROM {{eval_pairs}}),
{name}_cells AS (SELECT sample_id, system, len(a) AS n, (list_reduce(list_prepend({{'w': '', 'r': list_transform(range(0, len(a) + 1), lambda k: k * ({each} + 1))::BIGINT[]}}, list_transform(b, lambda w: {{'w': w, 'r': []::BIGINT[]}})),
  lambda above, x: {{'w': '', 'r': list_reduce(list_prepend([above.r[1] + {each}]::BIGINT[], list_transform(range(1, len(a) + 1), lambda j: [j]::BIGINT[])),
    lambda row, j: list_append(row, ({cell})::BIGINT))}})).r[-1] AS cell FROM {name}_parts),
{name} AS (SELECT sample_id, system, n, cell // {each} AS e, cell % {each} // 1000000 AS s, cell % 1000000 AS d FROM {name}_cells)"""


CHAR_EDITS, WORD_EDITS = _scripts("char_edits", "string_split({}, '')"), _scripts("word_edits", r"regexp_extract_all({}, '\S+')")
KINDS = "sum(s)::BIGINT AS substitutions, sum(d)::BIGINT AS deletions, sum(e - s - d)::BIGINT AS insertions, sum(e)::BIGINT AS edits"
_add("a21_cer", lambda s, d: scoring.cer(fx.eval_pairs(s, d)), _with(CHAR_EDITS, body=f"SELECT system, {KINDS}, sum(n)::BIGINT AS chars, sum(e)::DOUBLE / sum(n) AS cer, avg(e / n::DOUBLE) AS mean_cer FROM char_edits GROUP BY system"))
_add("a22_wer", lambda s, d: scoring.wer(fx.eval_pairs(s, d)), _with(WORD_EDITS, body=f"SELECT system, {KINDS}, sum(n)::BIGINT AS words, sum(e)::DOUBLE / sum(n) AS wer FROM word_edits GROUP BY system"))

# What the systems do to a text: one loses the h of each th, the other reads an o as i. The edits are so few and so far apart that an
# alignment has no other choice; scripts are held against a plain table in tests.
MISREAD = """misread AS (SELECT system, 'h' AS truth, '' AS pred, (length(truth) - length(pred))::BIGINT AS n FROM {eval_pairs} WHERE system = 'crnn'
  UNION ALL SELECT system, 'o', 'i', ((length(truth) - length(replace(truth, ' on', ''))) // 3)::BIGINT FROM {eval_pairs} WHERE system = 'transformer' AND truth <> pred)"""
_add(
    "a23_char_confusion", lambda s, d: scoring.char_confusion(fx.eval_pairs(s, d)),
    _with(MISREAD, body="SELECT system, truth, pred, sum(n)::BIGINT AS n, 1 AS rank FROM misread GROUP BY ALL HAVING sum(n) > 0"),
)
_add(
    "a23_char_errors", lambda s, d: scoring.char_errors(fx.eval_pairs(s, d)),
    _with(MISREAD, """shown AS (SELECT system, c AS truth, count(*) AS samples FROM (SELECT system, unnest(string_split(truth, '')) AS c FROM {eval_pairs}) GROUP BY ALL)""",
          body="SELECT system, truth, samples, coalesce(n, 0) / samples::DOUBLE AS error_rate FROM shown LEFT JOIN (SELECT system, truth, sum(n) AS n FROM misread GROUP BY ALL) USING (system, truth)"),
)


@query("""SELECT system, truth, pred, n, row_number() OVER (PARTITION BY system ORDER BY n DESC, truth, pred)::INT AS rank
FROM (SELECT system, truth, pred, count(*) AS n FROM {eval_pairs} WHERE truth <> pred GROUP BY ALL)""")
def a23_confusion(spark, d):
    return scoring.confusion(fx.eval_pairs(spark, d))


@query("""SELECT system, truth, pred, n, rank FROM (SELECT system, truth, pred, n, row_number() OVER (PARTITION BY system ORDER BY n DESC, truth, pred)::INT AS rank
FROM (SELECT system, truth, pred, count(*) AS n FROM {eval_pairs} WHERE truth <> pred GROUP BY ALL)) WHERE rank <= 5""")
def a23_top_confusions(spark, d):
    return scoring.confusion(fx.eval_pairs(spark, d), top=5)


@query("SELECT system, truth, count(*) AS samples, avg((truth <> pred)::INT::DOUBLE) AS error_rate FROM {eval_pairs} GROUP BY ALL")
def a23_class_errors(spark, d):
    return scoring.class_errors(fx.eval_pairs(spark, d))


_COMPARED = """metrics AS (SELECT system, 'accuracy' AS metric, avg((pred = truth)::INT::DOUBLE) AS value FROM {eval_pairs} GROUP BY system
  UNION ALL SELECT system, 'cer', sum(levenshtein(pred, truth))::DOUBLE / sum(length(truth)) FROM {eval_pairs} GROUP BY system
  UNION ALL SELECT system, 'wer', sum(e)::DOUBLE / sum(n) FROM word_edits GROUP BY system
  UNION ALL SELECT model_used, 'latency_ms', avg(processing_time_ms) FROM {recognized_texts} GROUP BY model_used
  UNION ALL SELECT model_used, 'latency_p50', quantile_cont(processing_time_ms, 0.5) FROM {recognized_texts} GROUP BY model_used
  UNION ALL SELECT model_used, 'latency_p95', quantile_cont(processing_time_ms, 0.95) FROM {recognized_texts} GROUP BY model_used
  UNION ALL SELECT model_used, 'params', sum(num_chars)::DOUBLE FROM {recognized_texts} GROUP BY model_used)"""


def _compared(spark, d, systems, small=True):
    rows = fx.recognized_texts(spark, d)
    sizes = rows.groupBy(F.col("model_used").alias("system")).agg(F.sum("num_chars").alias("params"))  # a stand-in that grows with the tables
    return scoring.compare_models(fx.eval_pairs(spark, d), rows.select(F.col("model_used").alias("system"), "processing_time_ms"), systems, sizes, small)


_add("a24_model_comparison", lambda s, d: _compared(s, d, ["crnn", "transformer"]), _with(WORD_EDITS, _COMPARED, body="SELECT metric, max(value) FILTER (system = 'crnn') AS crnn, max(value) FILTER (system = 'transformer') AS transformer FROM metrics GROUP BY metric"))
_add("j9_one_model", lambda s, d: _compared(s, d, ["crnn"]), _with(WORD_EDITS, _COMPARED, body="SELECT metric, max(value) FILTER (system = 'crnn') AS crnn FROM metrics GROUP BY metric"))


_SKETCHED = _COMPARED.replace("quantile_cont", "quantile_disc")
_add("a24_model_comparison_sketched", lambda s, d: _compared(s, d, ["crnn", "transformer"], small=False), _with(WORD_EDITS, _SKETCHED, body="SELECT metric, max(value) FILTER (system = 'crnn') AS crnn, max(value) FILTER (system = 'transformer') AS transformer FROM metrics GROUP BY metric"))


@query("""SELECT model_used, count(*) AS n, quantile_disc(processing_time_ms, 0.5) AS p50, quantile_disc(processing_time_ms, 0.9) AS p90, quantile_disc(processing_time_ms, 0.99) AS p99
FROM {recognized_texts} GROUP BY model_used""")
def a24_latency_by_days(spark, d):
    """Sketches of each day, merged into one of each model, which tells where the exact values are."""
    rows = fx.recognized_texts(spark, d)
    days = quantiles.sketches(rows, ["model_used"], "processing_time_ms", F.to_date("created_at"))
    return quantiles.refined(rows, ["model_used"], "processing_time_ms", dataset.SHARES, quantiles.merged(days, ["model_used"]))


@query("SELECT t.sample_id, t.truth, p.system, p.pred FROM (SELECT DISTINCT sample_id, truth FROM {eval_pairs}) t JOIN {eval_pairs} p USING (sample_id)")
def j8_truth_and_predictions(spark, d):
    pairs = fx.eval_pairs(spark, d)
    return scoring.joined_pairs(pairs.select("sample_id", "truth").distinct(), pairs.select("sample_id", "system", "pred"))


# ---- datasets

BUCKET = "(concat('0x', substr(md5(sample_id::VARCHAR), 1, 15))::BIGINT % 100)"


@query(f"SELECT sample_id, label, CASE WHEN {BUCKET} < 80 THEN 'train' WHEN {BUCKET} < 90 THEN 'valid' ELSE 'test' END AS split FROM {{class_samples}}")
def m1_split(spark, d):
    return dataset.split(fx.class_samples(spark, d), "sample_id")


def _exact(key: str) -> str:
    return f"""SELECT sample_id, label, CASE WHEN place < 80 THEN 'train' WHEN place < 90 THEN 'valid' ELSE 'test' END AS split FROM (SELECT sample_id, label,
  floor((row_number() OVER (ORDER BY md5({key}), sample_id) - 1) * 100 / count(*) OVER ()) AS place FROM {{class_samples}})"""


@query(_exact("concat('7:', sample_id)"))
def m1_seeded_exact_split(spark, d):
    return dataset.split(fx.class_samples(spark, d), "sample_id", seed=7, exact=True)


@query(f"SELECT split, count(*) AS n FROM ({_exact('sample_id::VARCHAR')}) GROUP BY split")
def m1_exact_counts(spark, d):
    return dataset.split(fx.class_samples(spark, d), "sample_id", exact=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


STRATIFIED = """SELECT sample_id, label, CASE WHEN place < 80 THEN 'train' WHEN place < 90 THEN 'valid' ELSE 'test' END AS split FROM (SELECT sample_id, label,
  floor((row_number() OVER (PARTITION BY label ORDER BY md5(sample_id::VARCHAR), sample_id) - 1) * 100 / count(*) OVER (PARTITION BY label)) AS place FROM {class_samples})"""


@query(STRATIFIED)
def m2_stratified_split(spark, d):
    return dataset.split(fx.class_samples(spark, d), "sample_id", stratify="label")


@query(f"""SELECT count(*) FILTER (a.split IS NULL OR b.split IS NULL) AS missing, count(*) FILTER (a.split <> b.split) AS moved
FROM (SELECT sample_id, CASE WHEN {BUCKET} < 80 THEN 'train' WHEN {BUCKET} < 90 THEN 'valid' ELSE 'test' END AS split FROM {{class_samples}}) a FULL JOIN ({STRATIFIED}) b USING (sample_id)""")
def m3_split_check(spark, d):
    return dataset.check_split(m1_split(spark, d), m2_stratified_split(spark, d), "sample_id")


@query(f"SELECT sample_id, label, split FROM ({STRATIFIED}) WHERE split = 'train'")
def m4_train_rows(spark, d):
    return dataset.for_augmentation(m2_stratified_split(spark, d))


CHARSET = "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM (SELECT DISTINCT label FROM {class_samples}) UNION ALL SELECT '<blank>', count(DISTINCT label)::INT FROM {class_samples}"


@query(CHARSET)
def m5_charset(spark, d):
    return dataset.build_charset(fx.class_samples(spark, d))


@query("SELECT sample_id, label FROM {class_samples} WHERE label::INT % 2 = 0")
def j5_known_labels(spark, d):
    samples = fx.class_samples(spark, d)
    return dataset.known_labels(samples, dataset.build_charset(samples.where("cast(label AS int) % 2 = 0"))).select("sample_id", "label")


@query("SELECT sample_id, label FROM {class_samples} WHERE label::INT % 2 <> 0")
def j5_unknown_labels(spark, d):
    samples = fx.class_samples(spark, d)
    return dataset.unknown_labels(samples, dataset.build_charset(samples.where("cast(label AS int) % 2 = 0"))).select("sample_id", "label")


@query("SELECT label, n, min(n) OVER () = max(n) OVER () AS balanced FROM (SELECT label, count(*) AS n FROM {class_samples} GROUP BY label)")
def a19_class_balance(spark, d):
    return dataset.class_balance(fx.class_samples(spark, d))


@query("""SELECT lang, min(n_chars) AS smallest, max(n_chars) AS largest, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY lang""")
def a19_size_distribution(spark, d):
    return dataset.size_distribution(fx.load(spark, d, "documents"), "n_chars", "lang", small=True)


@query("""SELECT lang, min(n_chars) AS smallest, max(n_chars) AS largest, avg(n_chars) AS mean, quantile_disc(n_chars, 0.5)::DOUBLE AS p50, quantile_disc(n_chars, 0.9)::DOUBLE AS p90, quantile_disc(n_chars, 0.99)::DOUBLE AS p99 FROM documents GROUP BY lang""")
def a19_size_sketches(spark, d):
    return dataset.size_distribution(fx.load(spark, d, "documents"), "n_chars", "lang")
