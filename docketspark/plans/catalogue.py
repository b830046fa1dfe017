"""Queries over the driver's tables, with the DuckDB SQL that each is held against.

The tables hold none of the engine's own entities, so operators run by analogy: tenant = nation, partner = customer
or documents.source, material = orders or documents (bytes = text), attempt and touch = events, known material =
labels. Fixed times stand for the clock.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark import schemas as S
from docketspark.functions import scalars as X
from docketspark.functions import validation as V
from docketspark.operators import ingest, maintenance, reads, throttle, transitions
from docketspark.operators.tenancy import bureau_by_slug, foreign_rows, tenant_scope
from docketspark.sources.bodies import list_response, patch_body
from docketspark.sources.tables import test_table

QUERIES: dict = {}
ORACLES: dict = {}

BUREAU = "00000000-0000-0000-0000-000000000007"
LATE = dt.datetime(2024, 1, 20)


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def as_of(spark: SparkSession, sf_dir: str):
    """Two thirds into the events, as a literal: midnight of 2024-01-20 UTC."""
    return F.lit(LATE).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


_EVENT_ID = "printf('00000000-0000-0000-0000-%012d', {})"


def uuid_like(n):
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))


# --- reads ----------------------------------------------------------------------------------------------------------


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = test_table(spark, sf_dir, "customer")
    at = F.timestamp_seconds(F.col("c_custkey"))
    return c.select(uuid_like(F.col("c_custkey")).alias("id"), uuid_like(F.col("c_nationkey")).alias("bureau_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("note"), at.alias("created_at"), at.alias("updated_at"))


_PARTNERS = f"(SELECT {_EVENT_ID.format('c_custkey')} AS id, {_EVENT_ID.format('c_nationkey')} AS bureau_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS note, c_custkey FROM customer)"


@query(f"SELECT id, name, note, make_timestamp(c_custkey * 1000000) AS created_at FROM {_PARTNERS} WHERE bureau_id = '{BUREAU}' ORDER BY created_at DESC, id DESC")
def tenant_list(spark, sf_dir):
    return reads.list_partners(partners(spark, sf_dir), BUREAU).drop("updated_at").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = CAST(nullif('', '') AS INTEGER)")
def fail_closed(spark, sf_dir):
    return tenant_scope(test_table(spark, sf_dir, "customer"), "", "c_nationkey").select("c_custkey", "c_name")


@query("SELECT count(*) AS foreign_rows FROM customer WHERE c_nationkey IS DISTINCT FROM 7")
def write_check(spark, sf_dir):
    return foreign_rows(test_table(spark, sf_dir, "customer"), "7", "c_nationkey").agg(F.count("*").alias("foreign_rows"))


@query(f"SELECT id, name, note FROM {_PARTNERS} WHERE bureau_id = '{BUREAU}' AND id = (SELECT max(id) FROM {_PARTNERS} WHERE bureau_id = '{BUREAU}')")
def point_lookup(spark, sf_dir):
    p = partners(spark, sf_dir)
    last = tenant_scope(p, BUREAU).agg(F.max("id")).first()[0]
    return reads.get_partner(p, BUREAU, last).select("id", "name", "note")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_custkey = 13 ORDER BY o_orderdate DESC, o_orderkey DESC")
def list_sorted(spark, sf_dir):
    o = test_table(spark, sf_dir, "orders").where(F.col("o_custkey") == 13)
    return reads.newest_first(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderkey")


@query(f"SELECT EXISTS (SELECT 1 FROM {_PARTNERS} WHERE bureau_id = '{BUREAU}' AND id = '{BUREAU}') AS found")
def exists_probe(spark, sf_dir):
    return reads.partner_exists(partners(spark, sf_dir), BUREAU, BUREAU)


@query("SELECT CASE WHEN event_type = 'click' THEN 'running' ELSE 'queued' END AS status, count(*) AS total FROM events GROUP BY 1")
def status_count(spark, sf_dir):
    return reads.count_by_status(jobs(spark, sf_dir), BUREAU)


@query("SELECT source, bool_or(lang IN ('de', 'fr')) AS pending FROM documents GROUP BY source")
def any_pending(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    status = F.when(F.col("lang") == "de", "queued").when(F.col("lang") == "fr", "processing").otherwise("completed")
    return reads.any_pending(d.select("source", status.alias("status")), "source")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def partner_guard(spark, sf_dir):
    d, known = test_table(spark, sf_dir, "documents"), test_table(spark, sf_dir, "labels")
    children = d.select("doc_id", "source", F.lit(BUREAU).alias("bureau_id"), uuid_like(F.col("doc_id")).alias("partner_id"))
    there = known.select(F.lit(BUREAU).alias("bureau_id"), uuid_like(F.col("doc_id")).alias("id"))
    return reads.with_partner(children, there).select("doc_id", "source")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as materials of one tenant, their source as the partner."""
    d = test_table(spark, sf_dir, "documents")
    at, none = F.timestamp_seconds(F.col("doc_id")), F.lit(None).cast("string")
    status = X.choose(F.col("doc_id") % 6, dict(enumerate(S.MATERIAL_STATUS)))
    digest = X.sha256_hex(F.col("text").cast("binary"))
    return d.select(
        uuid_like(F.col("doc_id")).alias("id"), F.lit(BUREAU).alias("bureau_id"), F.col("source").alias("partner_id"), F.lit("x.pdf").alias("filename"), F.lit("application/pdf").alias("media_type"),
        F.col("n_chars").alias("size_bytes"), digest.alias("sha256"), F.concat_ws("/", F.lit("k"), digest).alias("storage_key"), status.alias("status"), F.lit(None).cast("int").alias("page_count"), none.alias("error"), at.alias("created_at"), at.alias("updated_at"),
    )


_STATUS = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(S.MATERIAL_STATUS)) + " END"
_MATERIALS = f"(SELECT doc_id, {_EVENT_ID.format('doc_id')} AS id, source AS partner_id, sha256(text) AS sha256, n_chars AS size_bytes, {_STATUS} AS status FROM documents)"


@query(f"SELECT id, partner_id, size_bytes, status FROM {_MATERIALS} WHERE partner_id = (SELECT min(source) FROM documents)")
def material_list(spark, sf_dir):
    m = materials(spark, sf_dir)
    partner = m.agg(F.min("partner_id")).first()[0]
    return reads.list_materials(m, BUREAU, partner).select("id", "partner_id", "size_bytes", "status")


@query(f"SELECT id, size_bytes, status, 'k/' || sha256 AS storage_key FROM {_MATERIALS} WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def material_lookup(spark, sf_dir):
    m = materials(spark, sf_dir)
    one = m.agg(F.max_by(F.struct("partner_id", "id"), "id")).first()[0]
    return reads.get_material(m, BUREAU, one.partner_id, one.id).select("id", "size_bytes", "status", "storage_key")


@query(f"SELECT id, status FROM {_MATERIALS} WHERE (partner_id, sha256) IN (SELECT source, sha256(text) FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents))")
def digest_lookup(spark, sf_dir):
    m = materials(spark, sf_dir)
    one = m.agg(F.max_by(F.struct("partner_id", "sha256"), "id")).first()[0]
    return reads.find_by_digest(m, BUREAU, one.partner_id, one.sha256).select("id", "status")


@query(f"SELECT id, status FROM {_MATERIALS} WHERE (partner_id, sha256) IN (SELECT source, sha256(text) FROM documents JOIN labels USING (doc_id))")
def digest_lookup_bulk(spark, sf_dir):
    known = test_table(spark, sf_dir, "documents").join(test_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    wanted = known.select(F.lit(BUREAU).alias("bureau_id"), F.col("source").alias("partner_id"), X.sha256_hex(F.col("text").cast("binary")).alias("sha256"))
    return reads.find_all_by_digest(materials(spark, sf_dir), wanted).select("id", "status")


@query(f"SELECT {_EVENT_ID.format('event_id')} AS id, CASE WHEN event_type = 'click' THEN 'running' ELSE 'queued' END AS status, (event_id % 8)::INTEGER AS attempts FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def job_list(spark, sf_dir):
    last = test_table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    return reads.list_jobs(jobs(spark, sf_dir), BUREAU, str(last)).select("id", "status", "attempts")


@query("SELECT n_nationkey AS id FROM nation WHERE lower(n_name) = 'nation_7'")
def tenant_by_slug(spark, sf_dir):
    n = test_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"))
    return bureau_by_slug(n, "nation_7")


@query("SELECT n_nationkey, CASE WHEN NOT regexp_full_match(replace(lower(n_name), '_1', '-1'), '[a-z0-9-]{1,64}') THEN 'validation_failed' END AS error_code FROM nation")
def slug_verdict(spark, sf_dir):
    slug = F.replace(F.lower("n_name"), F.lit("_1"), F.lit("-1"))
    return test_table(spark, sf_dir, "nation").select("n_nationkey", V.slug_error(slug).alias("error_code"))


@query(
    """SELECT event_id, CASE WHEN ttl IS NULL OR ttl < 60 OR ttl > 604800 THEN 'validation_failed' END AS ttl_code, CASE WHEN ttl IS NULL OR ttl < 60 THEN 'validation_failed' END AS idle_code
       FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id * event_id END AS ttl FROM events)"""
)
def parameter_guard(spark, sf_dir):
    """The guards of a session's lifetime and idle time on requested seconds, missing ones included."""
    ttl = F.when(F.col("event_type") != "error", F.col("user_id") * F.col("event_id"))
    return test_table(spark, sf_dir, "events").select("event_id", V.range_error(ttl, 60, 604_800).alias("ttl_code"), V.range_error(ttl, 60).alias("idle_code"))


@query(
    f"""SELECT 'material' AS kind, id, CASE WHEN size_bytes % 5 = 0 OR size_bytes % 7 = 0 THEN 'validation_failed' END AS error_code FROM {_MATERIALS}
        UNION ALL SELECT 'job', {_EVENT_ID.format('event_id')}, CASE WHEN event_id % 9 = 0 OR event_id % 8 = 0 AND event_id % 2 = 1 THEN 'validation_failed' END FROM events
        UNION ALL SELECT 'session', user_id::VARCHAR, CASE WHEN user_id % 3 = 0 THEN 'validation_failed' END FROM events GROUP BY user_id"""
)
def row_checks(spark, sf_dir):
    m = materials(spark, sf_dir)
    m = m.withColumns({"sha256": F.when(F.col("size_bytes") % 5 == 0, F.upper(F.concat("sha256", F.lit("x")))).otherwise(F.col("sha256")), "media_type": F.when(F.col("size_bytes") % 7 == 0, "text/html").otherwise(F.col("media_type"))})
    number = F.substring("id", 25, 12).cast("long")
    j = jobs(spark, sf_dir).withColumn("lease_owner", F.when(number % 9 == 0, F.when(F.col("lease_owner").isNull(), "w")).otherwise(F.col("lease_owner")))
    s = sessions(spark, sf_dir).withColumn("csrf_token", F.when(F.col("id").cast("long") % 3 == 0, "short").otherwise(F.col("csrf_token")))
    of = lambda df, kind, error: df.select(F.lit(kind).alias("kind"), "id", error.alias("error_code"))
    return of(m, "material", V.material_error()).union(of(j, "job", V.job_error())).union(of(s, "session", V.session_error()))


@query("SELECT c_custkey AS request_id, c_custkey % 4 = 0 AS rejected, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment END AS note FROM customer")
def partner_insert(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("\n")))
    asked = test_table(spark, sf_dir, "customer").select(k.alias("request_id"), F.lit(BUREAU).alias("bureau_id"), name.alias("name"), F.when(k % 4 > 1, F.col("c_mktsegment")).otherwise("  ").alias("note"))
    new, bad = transitions.insert_partners(asked, as_of(spark, sf_dir))
    made = asked.select("request_id", ingest.uuid_of(F.col("bureau_id"), F.col("request_id")).alias("id")).join(new, "id")
    return made.select("request_id", F.lit(False).alias("rejected"), "name", "note").union(bad.select("request_id", F.lit(True), F.lit(None).cast("string"), F.lit(None).cast("string")))


@query(f"SELECT sha256(user_id::VARCHAR) AS token_fingerprint, n_nationkey AS bureau_id, TIMESTAMP '{LATE}' + INTERVAL 3600 SECONDS AS expires_at FROM (SELECT DISTINCT user_id FROM events) JOIN nation ON n_nationkey = user_id % 25")
def session_open(spark, sf_dir):
    n = test_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"))
    users = test_table(spark, sf_dir, "events").select("user_id").distinct().join(n, F.col("user_id") % 25 == F.col("id"))
    asked = users.select("slug", F.sha2(F.col("user_id").cast("string").cast("binary"), 256).alias("token_fingerprint"), F.lit("c" * 20).alias("csrf_token"))
    opened = transitions.open_sessions(asked, n, 3_600, as_of(spark, sf_dir))
    return opened.select("token_fingerprint", "bureau_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("SELECT page_id, count(*) OVER () >= 17 AS truncated FROM (SELECT page_id FROM pages ORDER BY page_id LIMIT 17)")
def bounded_listing(spark, sf_dir):
    from docketspark.sources.objects import bounded

    return bounded(test_table(spark, sf_dir, "pages").select("page_id"), "page_id", 17)


@query("SELECT conv_id, '{\"items\":[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn, role) || ']}' AS body FROM conversations GROUP BY conv_id")
def list_envelope(spark, sf_dir):
    return list_response(test_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"])


# --- scalars --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages")
def basename(spark, sf_dir):
    return test_table(spark, sf_dir, "pages").select("page_id", X.base_name(F.col("url")).alias("base"))


_WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


_CLEAN = _trim_sql(f"""regexp_replace({_trim_sql("regexp_replace(regexp_extract(replace(url, chr(92), '/'), '[^/]*$'), '\\p{Cc}', ' ', 'g')")}, '^\\.+|\\.+$', '', 'g')""")


@query(f"SELECT page_id, coalesce(nullif({_trim_sql(f'substring({_CLEAN}, 1, 200)')}, ''), 'upload.pdf') AS filename FROM pages")
def filename_display(spark, sf_dir):
    p = test_table(spark, sf_dir, "pages")
    return p.select("page_id", X.display_filename(F.col("url"), F.lit("application/pdf")).alias("filename"))


@query(f"SELECT page_id, CASE WHEN regexp_full_match(x, '[_ ]*') THEN 'original.png' ELSE x END AS fallback FROM (SELECT page_id, {_trim_sql("regexp_replace(url, '[^A-Za-z0-9.\\-_ ()+]', '_', 'g')")} AS x FROM pages)")
def filename_ascii(spark, sf_dir):
    return test_table(spark, sf_dir, "pages").select("page_id", X.disposition_ascii(F.col("url"), F.lit("image/png")).alias("fallback"))


@query("SELECT doc_id, 'UTF-8''''' || url_encode(text) AS encoded FROM documents")
def rfc5987(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.disposition_utf8(F.col("text")).alias("encoded"))


@query("SELECT page_id, CASE WHEN url LIKE '%.%' AND url NOT LIKE '%.' THEN upper(substring(regexp_extract(url, '[^.]*$'), 1, 3)) ELSE 'PNG' END AS label FROM pages")
def extension_label(spark, sf_dir):
    p = test_table(spark, sf_dir, "pages")
    return p.select("page_id", X.extension_label(F.col("url"), F.lit("image/png")).alias("label"))


_KEY_SQL = f"'bureau-' || {_EVENT_ID.format('length(lang)')} || '/partner-' || {_EVENT_ID.format('length(source)')} || '/' || substring(sha256(text), 1, 2) || '/' || sha256(text)"


@query(f"SELECT doc_id, {_KEY_SQL} AS key FROM documents")
def object_key(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    key = X.object_key(uuid_like(F.length("lang")), uuid_like(F.length("source")), X.sha256_hex(F.col("text").cast("binary")))
    return d.select("doc_id", key.alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256(text) END AS digest FROM documents")
def key_parse(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    digest = X.sha256_hex(F.col("text").cast("binary"))
    good = X.object_key(uuid_like(F.length("lang")), uuid_like(F.length("source")), digest)
    bad = F.concat(F.lit("/"), good)  # an absolute key is no key
    key = F.when(F.col("doc_id") % 3 == 0, bad).otherwise(good)
    return d.select("doc_id", X.parse_key(key)["digest"].alias("digest"))


@query("SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE html>%' THEN 'text/html' END AS media_type FROM pages")
def media_detect(spark, sf_dir):
    p = test_table(spark, sf_dir, "pages")
    return p.select("page_id", X.detect_media_type(F.col("html").cast("binary"), {"text/html": b"<!DOCTYPE html>"}).alias("media_type"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'application/pdf' WHEN 'click' THEN 'image/png' WHEN 'purchase' THEN 'image/jpeg' END AS media_type FROM events""")
def media_declared(spark, sf_dir):
    e = test_table(spark, sf_dir, "events")
    declared = X.choose(F.col("event_type"), {"view": " Application/X-PDF ; charset=binary", "click": "IMAGE/PNG", "purchase": "image/JPG;q=1"}, F.lit("text/plain"))
    return e.select("event_id", X.parse_media_type(declared).alias("media_type"))


@query(f"SELECT doc_id, CASE WHEN length(t) = 0 OR length(t) > 200 OR regexp_matches(t, '\\p{{Cc}}') THEN 'validation_failed' END AS error_code FROM (SELECT doc_id, {_trim_sql('text')} AS t FROM documents)")
def name_verdict(spark, sf_dir):
    return test_table(spark, sf_dir, "documents").select("doc_id", V.name_error(F.col("text")).alias("error_code"))


@query(f"SELECT doc_id, CASE WHEN length(t) > 10000 OR regexp_matches(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]') THEN 'validation_failed' END AS error_code FROM (SELECT doc_id, {_trim_sql('text')} AS t FROM documents)")
def note_verdict(spark, sf_dir):
    return test_table(spark, sf_dir, "documents").select("doc_id", V.note_error(F.col("text")).alias("error_code"))


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' Б'
       WHEN n < 1048576 THEN CASE WHEN n / 1024 >= 10 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT)::VARCHAR ELSE replace(printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10), '.0', '') END || ' КиБ'
       ELSE CASE WHEN n / 1048576 >= 10 THEN CAST(floor(n / 1048576 + 0.5) AS BIGINT)::VARCHAR ELSE replace(printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10), '.0', '') END || ' МиБ' END AS size_text
       FROM (SELECT doc_id, n_chars * (1 + doc_id % 7 * 100) AS n FROM documents)"""
)
def format_bytes(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.format_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 7 * 100)).alias("size_text"))


@query("SELECT event_id, CASE WHEN value > 0 THEN CAST(floor(user_id / value * 100 + 0.5) AS BIGINT) END AS percent FROM events")
def upload_percent(spark, sf_dir):
    return test_table(spark, sf_dir, "events").select("event_id", X.upload_percent(F.col("user_id"), F.col("value")).alias("percent"))


_SHOWN = ", ".join("('" + "', '".join(row) + "')" for row in X.STATUS_LABELS)


@query(f"SELECT doc_id, coalesce(label, status) AS label, coalesce(hint, '') AS hint, coalesce(tone, 'neutral') AS tone FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN lang ELSE CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(S.MATERIAL_STATUS)) + f" END END AS status FROM documents) LEFT JOIN (VALUES {_SHOWN}) l(status, label, hint, tone) USING (status)")
def status_label(spark, sf_dir):
    """Every status and, as an unknown one, the language."""
    status = X.choose(F.col("doc_id") % 7, dict(enumerate(S.MATERIAL_STATUS)), F.col("lang"))
    return test_table(spark, sf_dir, "documents").select("doc_id", X.status_presentation(status).alias("s")).select("doc_id", "s.*")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS can_retry, CASE o_orderstatus WHEN 'F' THEN 'material can be retried' WHEN 'P' THEN 'material can be retried' WHEN 'O' THEN 'material is already queued for extraction' END AS message FROM orders")
def retry_matrix(spark, sf_dir):
    o = test_table(spark, sf_dir, "orders")
    status = X.choose(F.col("o_orderstatus"), {"F": "failed", "P": "partial", "O": "queued"})
    return o.select("o_orderkey", X.can_retry(status).alias("can_retry"), X.retry_refusal(status).alias("message"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN 404 ELSE 500 END AS http_status, event_type <> 'view' AS retryable FROM events")
def error_codes(spark, sf_dir):
    e = test_table(spark, sf_dir, "events")
    code = X.choose(F.col("event_type"), {"click": "rate_limited", "view": "not_found"}, F.lit("internal_error"))
    return e.select("event_id", X.http_status(code).alias("http_status"), X.code_retryable(code).alias("retryable"))


@query("SELECT page_id, CASE WHEN url LIKE '%?utm_source=%' THEN regexp_extract(url, 'utm_source=([^&#;]*)', 1) WHEN page_id % 2 = 0 THEN 'later' END AS value FROM pages")
def cookie_value(spark, sf_dir):
    p = test_table(spark, sf_dir, "pages")
    header = F.concat(F.lit("a=1; "), F.replace(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit(";")), F.when(F.col("page_id") % 2 == 0, "; utm_source=later").otherwise(""))
    return p.select("page_id", X.cookie_value(header, "utm_source").alias("value"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, chr(32) || chr(10))), lambda x: x <> '')) AS BIGINT) AS parts FROM documents")
def csv_list(spark, sf_dir):
    return test_table(spark, sf_dir, "documents").select("doc_id", F.size(X.csv_list(F.col("text"))).cast("long").alias("parts"))


# --- intake ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents").select("doc_id", "source", X.sha256_hex(F.col("text").cast("binary")).alias("sha256"))
    return ingest.first_of_each(d, ["source", "sha256"], ["doc_id"]).select("doc_id", "source")


@query("SELECT conv_id, turn, (sum(length(text)) OVER w)::BIGINT AS upto, sum(length(text)) OVER w > 500 AND sum(length(text)) OVER w - length(text) <= 500 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)")
def size_limit(spark, sf_dir):
    c = test_table(spark, sf_dir, "conversations").withColumn("bytes", F.length("text").cast("long"))
    return ingest.first_over_limit(c, 500, ["conv_id"], ["turn", "role", "text"], "bytes").select("conv_id", "turn", "upto", "over")


@query(
    """WITH r AS (SELECT conv_id, count(*) FILTER (role = 'user') AS files, coalesce(sum(strlen(text)) FILTER (role <> 'user'), 0) AS other, max(CASE WHEN role = 'user' THEN strlen(text) END) AS size FROM conversations GROUP BY conv_id)
       SELECT conv_id, CASE WHEN files <> 1 THEN 'validation_failed' WHEN other > 400 THEN 'payload_too_large' WHEN size > 500 THEN 'payload_too_large' WHEN coalesce(size, 0) = 0 THEN 'validation_failed' ELSE 'unsupported_media_type' END AS error_code FROM r"""
)
def receive_uploads(spark, sf_dir):
    c = test_table(spark, sf_dir, "conversations")
    parts = c.select(
        F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("int").alias("seq"), F.when(F.col("role") == "user", "file").otherwise("other").alias("part_name"), F.lit("a.pdf").alias("filename"),
        F.lit("application/pdf").alias("declared_type"), F.col("text").cast("binary").alias("content"), F.lit("p").alias("partner_id"), F.lit("b").alias("bureau_id"), F.timestamp_seconds(F.col("turn")).alias("arrival"),
    )
    out = ingest.receive(parts, max_bytes=500, other_bytes=400)
    return out.select(F.col("request_id").cast(c.schema["conv_id"].dataType).alias("conv_id"), "error_code")


def known_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = test_table(spark, sf_dir, "labels")
    return known.select(F.lit(BUREAU).alias("bureau_id"), X.idempotency_key(F.lit("extract_document"), uuid_like(F.col("doc_id"))).alias("idempotency_key"))


@query(f"SELECT 'extract_document:' || {_EVENT_ID.format('doc_id')} AS idempotency_key, 'queued' AS status, 0 AS attempts, 5 AS max_attempts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def enqueue_idempotent(spark, sf_dir):
    d = test_table(spark, sf_dir, "documents")
    m = d.select(uuid_like(F.col("doc_id")).alias("id"), F.lit(BUREAU).alias("bureau_id"), F.col("source").alias("partner_id"), F.timestamp_seconds(F.col("doc_id")).alias("updated_at"))
    return ingest.enqueue(m, known_jobs(spark, sf_dir)).select("idempotency_key", "status", "attempts", "max_attempts")


def received_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = test_table(spark, sf_dir, "documents")
    base = d.select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("request_id"), F.timestamp_seconds(F.col("doc_id")).alias("arrival"), F.lit(BUREAU).alias("bureau_id"), F.col("source").alias("partner_id"),
        X.sha256_hex(F.col("text").cast("binary")).alias("sha256"), F.lit("x.pdf").alias("filename"), F.lit("application/pdf").alias("media_type"), F.col("n_chars").alias("size_bytes"), F.lit(None).cast("string").alias("error_code"),
    )
    known = base.join(test_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("bureau_id", "partner_id", "sha256").agg(uuid_like(F.min("doc_id")).alias("id"))
    return base.drop("doc_id"), known


@query(
    f"""WITH d AS (SELECT doc_id, source, sha256(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
        k AS (SELECT source, h, min(doc_id) AS first FROM d WHERE known GROUP BY ALL),
        o AS (SELECT source, h, min(doc_id) AS first FROM d GROUP BY ALL)
        SELECT doc_id, CASE WHEN k.first IS NULL AND o.first = doc_id THEN 'created' ELSE 'duplicate' END AS outcome, CASE WHEN k.first IS NOT NULL THEN {_EVENT_ID.format('k.first')} END AS known_id
        FROM d JOIN o USING (source, h) LEFT JOIN k USING (source, h)"""
)
def upsert_or_get(spark, sf_dir):
    received, known = received_documents(spark, sf_dir)
    out, _, _ = ingest.ingest(received, known, known_jobs(spark, sf_dir))
    return out.select(F.col("request_id").cast("long").alias("doc_id"), "outcome", F.when(F.col("material_id").startswith("00000000-0000"), F.col("material_id")).alias("known_id"))


_NEW = "(SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, sha256(text) HAVING count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) = 0)"


@query(f"SELECT count(*) FILTER (doc_id % 3 = 0 AND doc_id % 5 > 0) AS materials_without_job, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 3 > 0) AS jobs_without_material FROM {_NEW}")
def publish_invariant(spark, sf_dir):
    """A publication torn apart: every third material lost its job, every fifth job its material."""
    received, known = received_documents(spark, sf_dir)
    _, new, jobs = ingest.ingest(received, known, known_jobs(spark, sf_dir).limit(0))
    number = F.unix_timestamp("created_at")
    a, b = ingest.job_gaps(new.where(number % 5 > 0), jobs.where(number % 3 > 0))
    return a.agg(F.count("*").alias("materials_without_job")).crossJoin(b.agg(F.count("*").alias("jobs_without_material")))  # one row each


@query("SELECT count(*) AS violations FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)")
def fk_violations(spark, sf_dir):
    gaps = ingest.key_gaps(test_table(spark, sf_dir, "lineitem"), test_table(spark, sf_dir, "orders"), {"l_orderkey": "o_orderkey"})
    return gaps.agg(F.count("*").alias("violations"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'write' WHEN l.quality = 1 THEN 'already_present' ELSE 'replace' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY action")
def put_plan(spark, sf_dir):
    from docketspark.sources.objects import plan_puts

    d = test_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("n_chars").alias("size_bytes"))
    there = test_table(spark, sf_dir, "labels").join(test_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    there = there.select(F.col("doc_id").cast("string").alias("key"), (F.col("n_chars") + 1 - F.col("quality")).alias("length"))
    return plan_puts(d, there).groupBy("action").agg(F.count("*").alias("n"))


# --- transitions --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'new name' END, c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'new note' ELSE c_mktsegment END AS note FROM customer""")
def patch(spark, sf_dir):
    c = test_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.concat(
        F.lit("{"),
        F.concat_ws(",", F.when(k % 2 == 0, F.lit('"name": "new name"')), F.when(k % 3 == 0, F.lit('"note": null')).when(k % 3 == 1, F.lit('"note": "new note"'))),
        F.lit("}"),
    )
    body = c.withColumn("b", patch_body(raw))
    name, note = transitions.patched(F.col("c_name"), F.col("c_mktsegment"), F.col("b.name"), F.col("b.has_note"), F.col("b.note"))
    return body.select("c_custkey", name.alias("name"), note.alias("note"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    none = F.lit(None).cast("string")
    lease = F.when(F.col("event_type") == "click", F.col("at"))
    return e.select(
        uuid_like(F.col("event_id")).alias("id"), F.lit(BUREAU).alias("bureau_id"), F.col("user_id").cast("string").alias("partner_id"), uuid_like(F.col("event_id")).alias("material_id"), F.lit("extract_document").alias("kind"),
        F.when(F.col("event_type") == "click", "running").otherwise("queued").alias("status"), none.alias("stage"), (F.col("event_id") % 8).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"),
        X.idempotency_key(F.lit("extract_document"), uuid_like(F.col("event_id"))).alias("idempotency_key"), F.col("at").alias("run_after"), F.when(lease.isNotNull(), "w").alias("lease_owner"), lease.alias("lease_expires_at"), none.alias("error"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )


_LOST = f"event_type = 'click' AND ts < TIMESTAMP '{LATE}'"


@query(
    f"""SELECT event_id, CASE WHEN {_LOST} THEN CASE WHEN event_id % 8 >= 5 THEN 'failed' ELSE 'queued' END WHEN event_type = 'click' THEN 'running' ELSE 'queued' END AS status,
        CASE WHEN {_LOST} AND event_id % 8 >= 5 THEN 'attempt limit reached after an interrupted run' END AS error, event_type = 'click' AND NOT ({_LOST}) AS leased FROM events"""
)
def lease_reclaim(spark, sf_dir):
    after, _ = transitions.reclaim_expired_leases(jobs(spark, sf_dir), BUREAU, as_of(spark, sf_dir))
    return after.select(F.substring("id", 25, 12).cast("long").alias("event_id"), "status", "error", F.col("lease_owner").isNotNull().alias("leased"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 4 = 1 THEN 'queued' WHEN event_id % 4 = 2 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN event_id % 4 < 2 THEN greatest(5, event_id % 8 + 1) ELSE 5 END::INTEGER AS max_attempts FROM events""")
def requeue(spark, sf_dir):
    j = jobs(spark, sf_dir)
    n = F.substring("id", 25, 12).cast("long") % 4
    status = F.when(n == 0, "failed").when(n == 1, "partial").when(n == 2, "completed").otherwise("failed")
    m = j.select(F.col("material_id").alias("id"), "bureau_id", "partner_id", status.alias("status"), F.lit("boom").alias("error"), "updated_at")
    asked = m.where(F.substring("id", 25, 12).cast("long") % 4 < 3).select("bureau_id", "partner_id", F.col("id").alias("material_id"))
    materials, after, _ = transitions.retry_materials(m, j, asked, as_of(spark, sf_dir))
    both = materials.select("id", "status").join(after.select(F.col("material_id").alias("id"), "max_attempts"), "id")
    return both.select(F.substring("id", 25, 12).cast("long").alias("event_id"), "status", "max_attempts")


@query("SELECT id FROM (SELECT r_regionkey::VARCHAR AS id, 0 AS rank FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'new', 1) ORDER BY rank LIMIT 1")
def bootstrap_union(spark, sf_dir):
    r = test_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("slug"))
    return transitions.provision(r, "ASIA", "Asia", as_of(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_seen_at"))
    return e.select(
        F.col("user_id").cast("string").alias("id"), F.lit(BUREAU).alias("bureau_id"), F.sha2(F.col("user_id").cast("string").cast("binary"), 256).alias("token_fingerprint"), F.lit("csrf-csrf-csrf-csrf-csrf").alias("csrf_token"),
        "created_at", "last_seen_at", (F.col("created_at") + transitions.seconds(2_592_000 - 86_400)).alias("expires_at"),
    )


_SESSIONS = "(SELECT user_id, max(ts) AS seen, min(ts) + INTERVAL 2505600 SECONDS AS expires FROM events GROUP BY user_id)"
END = dt.datetime(2024, 1, 30, 12)


def _live_sql(at: dt.datetime) -> str:
    return f"expires > TIMESTAMP '{at}' AND seen > TIMESTAMP '{at}' - INTERVAL 7200 SECONDS"


@query(f"SELECT user_id FROM {_SESSIONS} WHERE {_live_sql(END)}")
def session_live(spark, sf_dir):
    live, _ = transitions.purge_sessions(sessions(spark, sf_dir), 7200, F.lit(END).cast("timestamp"))
    return live.select(F.col("id").cast("long").alias("user_id"))


@query(f"SELECT count(*) AS purged FROM {_SESSIONS} WHERE NOT ({_live_sql(END)})")
def purge_complement(spark, sf_dir):
    return transitions.purge_sessions(sessions(spark, sf_dir), 7200, F.lit(END).cast("timestamp"))[1]


def fingerprint(user_id: int) -> str:
    return hashlib.sha256(str(user_id).encode()).hexdigest()


@query(f"SELECT user_id::VARCHAR AS session_id, '{BUREAU}' AS bureau_id FROM {_SESSIONS} WHERE user_id < 20 AND {_live_sql(END)}")
def session_touch(spark, sf_dir):
    _, touched = transitions.touch_sessions(sessions(spark, sf_dir), [fingerprint(i) for i in range(20)], 7200, F.lit(END).cast("timestamp"))
    return touched.select("session_id", "bureau_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id <> 5")
def session_close(spark, sf_dir):
    rest, _ = transitions.close_session(sessions(spark, sf_dir), fingerprint(5))
    return rest.select(F.col("id").cast("long").alias("user_id"))


@query(f"SELECT id, CASE WHEN c_custkey % 2 = 0 THEN 'new name' ELSE name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'new note' ELSE note END AS note FROM {_PARTNERS}")
def patch_rows(spark, sf_dir):
    """Every partner is patched: name, note, both, or neither, which is refused and changes nothing."""
    p = partners(spark, sf_dir)
    k = F.substring("id", 25, 12).cast("long")
    patches = p.select("id", "bureau_id", F.when(k % 2 == 0, " new name ").alias("name"), (k % 3 < 2).alias("has_note"), F.when(k % 3 == 1, "new note").alias("note"))
    return transitions.patch_partners(p, patches, as_of(spark, sf_dir))[0].select("id", "name", "note")


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.v, o.lang) AS lang, coalesce(o.n_chars, -1)::BIGINT AS position FROM documents o FULL JOIN (SELECT doc_id + 50 AS doc_id, 'new' AS v FROM labels) n ON n.doc_id = o.doc_id")
def client_upsert(spark, sf_dir):
    shown = test_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("p").alias("partner_id"), "lang", F.col("n_chars").alias("position"))
    incoming = test_table(spark, sf_dir, "labels").select((F.col("doc_id") + 50).alias("id"), F.lit("p").alias("partner_id"), F.lit("new").alias("lang"))
    return transitions.upsert_list(shown, incoming, "p").select(F.col("id").alias("doc_id"), "lang", "position")


# --- state machines and maintenance ----------------------------------------------------------------------------------------

_THROTTLE = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT event_id, user_id, k, t, 1 AS n, t AS w, NULL::BIGINT AS l, true AS admitted FROM e WHERE k = 1
  UNION ALL
  SELECT event_id, user_id, k, t,
         CASE WHEN locked THEN n WHEN fresh THEN 1 WHEN n >= 3 THEN n ELSE n + 1 END,
         CASE WHEN NOT locked AND fresh THEN t ELSE w END,
         CASE WHEN locked THEN l WHEN fresh THEN NULL WHEN n >= 3 THEN t + 172800000000 END,
         NOT locked AND (fresh OR n < 3)
  FROM (SELECT e.event_id, e.user_id, e.k, e.t, s.n, s.w, s.l, s.l IS NOT NULL AND s.l > e.t AS locked,
               s.l IS NOT NULL OR e.t - s.w > 259200000000 AS fresh
        FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
)
SELECT event_id, admitted FROM s
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "at", F.lit("attempt").alias("kind"))


@query(_THROTTLE)
def login_throttle(spark, sf_dir):
    return throttle.throttle(attempts(spark, sf_dir), 3, 3 * 86_400, 2 * 86_400).select(F.col("id").alias("event_id"), "admitted")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, min(ts) OVER (PARTITION BY user_id) AS opened, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       s AS (SELECT event_id, user_id, k, ts, true AS live FROM e WHERE k = 1
             UNION ALL SELECT e.event_id, e.user_id, e.k, e.ts, s.live AND e.ts - s.ts < INTERVAL 2 DAYS AND e.ts - e.opened < INTERVAL 7 DAYS FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
       SELECT event_id, live FROM s"""
)
def session_replay(spark, sf_dir):
    e = attempts(spark, sf_dir).drop("kind")
    return throttle.replay_touches(e, 2 * 86_400, 7 * 86_400).select(F.col("id").alias("event_id"), "live")


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = test_table(spark, sf_dir, "documents")
    bureau = F.when(F.col("lang") == "en", BUREAU).otherwise(uuid_like(F.lit(8)))
    return d.select("doc_id", X.object_key(bureau, uuid_like(F.length("source")), X.sha256_hex(F.col("text").cast("binary"))).alias("key"))


def known_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = test_table(spark, sf_dir, "documents").join(test_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.select(F.lit(BUREAU).alias("bureau_id"), uuid_like(F.length("source")).alias("partner_id"), X.sha256_hex(F.col("text").cast("binary")).alias("sha256"))


_ORPHANS = "FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM documents k JOIN labels USING (doc_id) WHERE length(k.source) = length(d.source) AND k.text = d.text)"


@query(f"SELECT doc_id {_ORPHANS}")
def orphans(spark, sf_dir):
    return maintenance.orphans(store_listing(spark, sf_dir), known_materials(spark, sf_dir), BUREAU).select("doc_id")


@query(f"SELECT count(*) AS removed, coalesce(sum(user_id), 0)::BIGINT AS removed_bytes FROM events WHERE ts <= TIMESTAMP '{LATE}' - INTERVAL 3600 SECONDS")
def staging_sweep(spark, sf_dir):
    files = events(spark, sf_dir).select(F.col("at").alias("modified"), F.col("user_id").alias("length"))
    return maintenance.staging_totals(maintenance.stale_staging(files, as_of(spark, sf_dir)))


@query(
    f"""SELECT (SELECT count(*) FROM {_SESSIONS} WHERE NOT ({_live_sql(LATE)})) AS purged, (SELECT count(*) FROM events WHERE {_LOST}) AS reclaimed,
        (SELECT count(*) FROM events WHERE ts <= TIMESTAMP '{LATE}' - INTERVAL 3600 SECONDS) AS removed, (SELECT sum(user_id) FROM events WHERE ts <= TIMESTAMP '{LATE}' - INTERVAL 3600 SECONDS)::BIGINT AS removed_bytes,
        (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) {_ORPHANS}) AS orphans, false AS truncated"""
)
def maintenance_report(spark, sf_dir):
    files = events(spark, sf_dir).select(F.col("at").alias("modified"), F.col("user_id").alias("length"))
    return maintenance.maintenance_report(sessions(spark, sf_dir), jobs(spark, sf_dir), files, store_listing(spark, sf_dir), False, known_materials(spark, sf_dir), BUREAU, 7200, as_of(spark, sf_dir))



@query(_THROTTLE)
def login_throttle_stream(spark, sf_dir):
    """The throttle as a stream over the events folder, run to its end; one table in the shared folder is its sink."""
    from docketspark.session import shared_path
    from docketspark.streaming.throttle import throttle_stream

    root = shared_path(spark, "throttle")
    stream = spark.readStream.schema(test_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit("attempt").alias("kind"))
    out = throttle_stream(stream, 3, 3 * 86_400, 2 * 86_400)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        done = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out").select(F.col("id").alias("event_id"), "admitted")


_PAGE_OBJECTS = f"(SELECT DISTINCT 'bureau-{BUREAU}/partner-{BUREAU}/' || substring(sha256(html), 1, 2) || '/' || sha256(html) AS key, strlen(html)::BIGINT AS length, sha256(html) AS sha256 FROM pages)"


def published(spark: SparkSession, sf_dir: str) -> str:
    """The root of a new store that holds the pages as objects."""
    from docketspark.session import shared_path
    from docketspark.sources.objects import publish

    root = shared_path(spark, "objects")
    content = F.col("html").cast("binary")
    pages = test_table(spark, sf_dir, "pages").select(X.object_key(F.lit(BUREAU), F.lit(BUREAU), X.sha256_hex(content)).alias("key"), content.alias("content"))
    publish(pages.dropDuplicates(["key"]), root).agg(F.count("*")).collect()
    return root


@query(f"SELECT key, length FROM {_PAGE_OBJECTS}")
def object_scan(spark, sf_dir):
    """The store listed by name and length; contents stay unread."""
    from docketspark.sources.objects import object_files

    return object_files(spark, published(spark, sf_dir)).where(X.parse_key(F.col("key")).isNotNull()).select("key", "length")


@query(f"SELECT sha256, length FROM {_PAGE_OBJECTS}")
def object_read(spark, sf_dir):
    from docketspark.sources.objects import read_objects

    return read_objects(spark, published(spark, sf_dir)).select("sha256", "length")


@query(f"SELECT key, length FROM {_PAGE_OBJECTS} WHERE length % 2 = 1")
def object_sweep(spark, sf_dir):
    """What is left of the store after a sweep of every object of even length."""
    from docketspark.sources.objects import object_files, sweep

    root = published(spark, sf_dir)
    sweep(object_files(spark, root).where(F.col("length") % 2 == 0))
    return object_files(spark, root).select("key", "length")
