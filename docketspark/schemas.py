"""Schemas and closed value sets. Timestamps are UTC instants; identifiers are lower-case canonical UUID texts."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
MATERIAL_STATUS = ("queued", "processing", "completed", "partial", "failed", "quarantined")
JOB_STATUS = ("queued", "running", "completed", "failed", "cancelled")
JOB_KIND = ("extract_document",)
MEDIA_TYPES = ("application/pdf", "image/png", "image/jpeg")
RETRYABLE_STATUS = ("failed", "partial")
NAME_MAX, NOTE_MAX, FILENAME_MAX, ERROR_MAX = 200, 10_000, 200, 2_000
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
OTHER_FIELDS_MAX_BYTES = 64 * 1024
MAX_ATTEMPTS = 5

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def schema(text: str) -> T.StructType:
    """'name type' pairs, comma-separated; a type that ends in ? is nullable."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")) for name, kind in fields])


BUREAUS = schema("id string, slug string, name string, created_at timestamp, updated_at timestamp")
PARTNERS = schema("id string, bureau_id string, name string, note string?, created_at timestamp, updated_at timestamp")
MATERIALS = schema(
    "id string, bureau_id string, partner_id string, filename string, media_type string, size_bytes long, sha256 string, storage_key string, "
    "status string, page_count int?, error string?, created_at timestamp, updated_at timestamp"
)
JOBS = schema(
    "id string, bureau_id string, partner_id string, material_id string, kind string, status string, stage string?, attempts int, max_attempts int, "
    "idempotency_key string, run_after timestamp, lease_owner string?, lease_expires_at timestamp?, error string?, created_at timestamp, updated_at timestamp"
)
SESSIONS = schema("id string, bureau_id string, token_fingerprint string, csrf_token string, created_at timestamp, last_seen_at timestamp, expires_at timestamp")
#: A part of a multipart upload; content is one chunk, seq its place.
UPLOAD_PARTS = schema(
    "request_id string, seq int, part_name string, filename string?, declared_type string?, content binary, partner_id string, bureau_id string, arrival timestamp"
)

# What leaves the engine: internal keys, lease columns and the tenant don't.
PARTNER_COLUMNS = ("id", "name", "note", "created_at", "updated_at")
MATERIAL_COLUMNS = ("id", "partner_id", "filename", "media_type", "size_bytes", "status", "page_count", "error", "created_at", "updated_at")
JOB_COLUMNS = ("id", "partner_id", "material_id", "kind", "status", "stage", "attempts", "error", "created_at", "updated_at")
