"""Row checks. Each returns an error code, or null where the value is fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark import schemas as S
from docketspark.functions.scalars import trim_white

INVALID = "validation_failed"


def _code(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(INVALID))


def clean_name(raw: Column) -> Column:
    return trim_white(raw)


def name_error(raw: Column, longest: int = S.NAME_MAX) -> Column:
    name = trim_white(raw)
    return _code(name.isNull() | (name == "") | (F.length(name) > longest) | name.rlike(r"\p{Cc}"))


def clean_note(raw: Column) -> Column:
    """Blank notes are null."""
    return F.nullif(trim_white(raw), F.lit(""))


def note_error(raw: Column, longest: int = S.NOTE_MAX) -> Column:
    note = clean_note(raw)
    return F.when(note.isNotNull() & ((F.length(note) > longest) | note.rlike(r"[\p{Cc}&&[^\n\t]]")), F.lit(INVALID))


def file_size_error(size: Column, longest: int = S.MAX_UPLOAD_BYTES) -> Column:
    return F.when(size > longest, F.lit("payload_too_large")).when(F.coalesce(size, F.lit(0)) <= 0, F.lit(INVALID))


def slug_error(slug: Column) -> Column:
    return _code(~slug.rlike(r"\A[a-z0-9-]{1,64}\z"))


def digest_error(digest: Column) -> Column:
    return _code(~digest.rlike(r"\A[0-9a-f]{64}\z"))


def in_range(value: int | None, least: int, most: int | None, what: str) -> int:
    """A parameter's guard: null and values outside are refused."""
    if value is None or value < least or (most is not None and value > most):
        raise ValueError(f"{what} out of range")
    return value


def range_error(value: Column, least: int, most: int | None = None) -> Column:
    """The same guard on a column."""
    bad = value.isNull() | (value < least)
    return _code(bad if most is None else bad | (value > most))


def material_error() -> Column:
    """The table's checks on a row of materials."""
    bad = ~F.col("media_type").isin(*S.MEDIA_TYPES) | (F.col("size_bytes") <= 0) | digest_error(F.col("sha256")).isNotNull() | ~F.col("status").isin(*S.MATERIAL_STATUS)
    bad |= F.coalesce(F.col("page_count") < 0, F.lit(False)) | F.coalesce(F.length("error") > S.ERROR_MAX, F.lit(False))
    return _code(bad)


def job_error() -> Column:
    """The table's checks on a row of jobs: lease owner and expiry are both there or both not."""
    bad = ~F.col("kind").isin(*S.JOB_KIND) | ~F.col("status").isin(*S.JOB_STATUS) | (F.col("attempts") < 0) | (F.col("max_attempts") <= 0)
    bad |= F.col("lease_owner").isNull() != F.col("lease_expires_at").isNull()
    return _code(bad)


def session_error() -> Column:
    return _code(digest_error(F.col("token_fingerprint")).isNotNull() | ~F.length("csrf_token").between(20, 200))
