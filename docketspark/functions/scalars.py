"""Scalar rules as Column -> Column functions. Lengths and places are in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark import schemas as S

#: Unicode White_Space, which Spark's trim() doesn't know.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_HEX = "[0-9a-f]"
_UUID = rf"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
KEY = rf"\Abureau-({_UUID})/partner-({_UUID})/({_HEX}{{2}})/(\3{_HEX}{{62}})\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_white(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def choose(x: Column, values: dict, other: Column | None = None) -> Column:
    """values[x], else other (null)."""
    out = reduce(lambda acc, kv: acc.when(x == F.lit(kv[0]), F.lit(kv[1])), values.items(), F)
    return out if other is None else out.otherwise(other)


# --- media types ------------------------------------------------------------------------------------------------

# Names a client may declare, and the signatures that decide.
DECLARED = {
    "application/pdf": "application/pdf",
    "application/x-pdf": "application/pdf",
    "image/png": "image/png",
    "image/jpeg": "image/jpeg",
    "image/jpg": "image/jpeg",
}
SIGNATURES = {"application/pdf": b"%PDF-", "image/png": b"\x89PNG\r\n\x1a\n", "image/jpeg": b"\xff\xd8\xff"}
EXTENSIONS = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg"}
SHORTEST_PREFIX = 4


def parse_media_type(declared: Column) -> Column:
    """The accepted type that a declared one names, parameters and case aside; null for any other."""
    return choose(ascii_lower(trim_white(F.substring_index(declared, ";", 1))), DECLARED)


def detect_media_type(content: Column, signatures: dict[str, bytes] | None = None) -> Column:
    """The type whose signature content (binary) begins with; null for none and for fewer than four bytes."""
    out = F.when(F.octet_length(content) < SHORTEST_PREFIX, F.lit(None).cast("string"))
    for media, sign in (signatures or SIGNATURES).items():
        out = out.when(F.startswith(content, F.lit(sign)), F.lit(media))
    return out


def media_conflict(declared: Column, detected: Column) -> Column:
    """Error code of an upload's type: undetected content, or a declared type that is known and another; null if fine."""
    known = parse_media_type(declared)
    return F.when(detected.isNull() | (known.isNotNull() & (known != detected)), F.lit("unsupported_media_type"))


# --- file names -------------------------------------------------------------------------------------------------


def base_name(name: Column) -> Column:
    """What follows the last slash, of either kind."""
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)


def display_filename(name: Column, media: Column) -> Column:
    clean = trim_white(F.regexp_replace(trim_white(F.regexp_replace(base_name(name), r"\p{Cc}", " ")), r"\A\.+|\.+\z", ""))
    short = trim_white(F.substring(clean, 1, S.FILENAME_MAX))
    return F.coalesce(F.nullif(short, F.lit("")), F.concat(F.lit("upload."), choose(media, EXTENSIONS)))


def disposition_ascii(name: Column, media: Column) -> Column:
    plain = trim_white(F.regexp_replace(name, r"[^A-Za-z0-9.\-_ ()+]", "_"))
    return F.when(plain.rlike(r"\A[_ ]*\z"), F.concat(F.lit("original."), choose(media, EXTENSIONS))).otherwise(plain)


def disposition_utf8(name: Column) -> Column:
    """RFC 5987: unreserved are letters, digits and -._~ only."""
    form = F.url_encode(name)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.concat(F.lit("UTF-8''"), form)


def extension_label(name: Column, media: Column) -> Column:
    tail = F.substring_index(name, ".", -1)
    by_media = F.when(F.contains(media, F.lit("pdf")), "PDF").when(F.contains(media, F.lit("png")), "PNG").when(media.rlike("jpe?g"), "JPG").otherwise("·")
    return F.when(F.contains(name, F.lit(".")) & (tail != ""), F.upper(F.substring(tail, 1, 3))).otherwise(by_media)


# --- content-addressed keys ---------------------------------------------------------------------------------------


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def object_key(bureau: Column, partner: Column, digest: Column) -> Column:
    """Null unless digest is 64 lower-case hex digits."""
    key = F.concat(F.lit("bureau-"), bureau, F.lit("/partner-"), partner, F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), digest)
    return F.when(digest.rlike(rf"\A{_HEX}{{64}}\z"), key)


def parse_key(key: Column) -> Column:
    """struct(bureau_id, partner_id, digest), null unless key is canonical and its shard starts its digest."""
    part = lambda i, name: F.regexp_extract(key, KEY, i).alias(name)
    return F.when(key.rlike(KEY), F.struct(part(1, "bureau_id"), part(2, "partner_id"), part(4, "digest")))


def idempotency_key(kind: Column, material: Column) -> Column:
    return F.concat(kind, F.lit(":"), material)


# --- closed sets and states -----------------------------------------------------------------------------------------


def checked_enum(x: Column, allowed: tuple[str, ...], what: str) -> Column:
    """x; an unknown value fails the read, null stays null."""
    return F.when(x.isNull() | x.isin(*allowed), x).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), x)))


def can_retry(status: Column) -> Column:
    return status.isin(*S.RETRYABLE_STATUS)


# Messages, codes and labels.
RETRY_MESSAGES = {
    "queued": "material is already queued for extraction",
    "processing": "material is being processed right now",
    "completed": "material has already been extracted",
    "quarantined": "quarantined material cannot be retried",
    "failed": "material can be retried",
    "partial": "material can be retried",
}
HTTP_STATUS = {
    "validation_failed": 422,
    "bad_request": 400,
    "unauthorized": 401,
    "invalid_csrf_token": 403,
    "forbidden": 403,
    "not_found": 404,
    "method_not_allowed": 405,
    "conflict": 409,
    "payload_too_large": 413,
    "unsupported_media_type": 415,
    "rate_limited": 429,
    "service_unavailable": 503,
    "internal_error": 500,
}
RETRYABLE_CODES = ("rate_limited", "service_unavailable", "internal_error")
STATUS_LABELS = [
    ("queued", "В очереди", "Ожидает обработки. Файл ещё не прочитан.", "neutral"),
    ("processing", "Обрабатывается", "Извлечение содержимого выполняется.", "progress"),
    ("completed", "Готово", "Обработка завершена.", "success"),
    ("partial", "Частично готово", "Часть страниц не удалось обработать.", "warn"),
    ("failed", "Ошибка обработки", "Обработка не выполнена.", "error"),
    ("quarantined", "Заблокировано проверкой", "Файл не прошёл проверку безопасности и не будет обработан.", "error"),
]
BYTE_UNITS = ("Б", "КиБ", "МиБ", "ГиБ")


def status_presentation(status: Column) -> Column:
    """label, hint and tone of a material's status; an unknown one is its own label."""
    of = lambda k: {row[0]: row[k] for row in STATUS_LABELS}
    return F.struct(choose(status, of(1), status).alias("label"), choose(status, of(2), F.lit("")).alias("hint"), choose(status, of(3), F.lit("neutral")).alias("tone"))


def retry_refusal(status: Column) -> Column:
    return choose(status, RETRY_MESSAGES)


def http_status(code: Column) -> Column:
    return choose(code, HTTP_STATUS)


def code_retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE_CODES)


# --- numbers and small texts ------------------------------------------------------------------------------------------


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def format_bytes(n: Column) -> Column:
    """Powers of 1024: bytes whole, from 10 units on whole, below with one decimal unless that is 0."""
    out = F.when(n.isNull() | (n < 0), F.lit("—")).when(n < 1024, F.concat_ws(" ", n.cast("long").cast("string"), F.lit(BYTE_UNITS[0])))
    for power, unit in enumerate(BYTE_UNITS[1:], 1):
        value = n.cast("double") / float(1024**power)
        tenths = _half_up(value * 10).cast("long")
        text = F.when(value >= 10, _half_up(value).cast("long").cast("string"))
        text = text.otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))))
        text = F.concat_ws(" ", text, F.lit(unit))
        out = out.when(value < 1024, text) if power < len(BYTE_UNITS) - 1 else out.otherwise(text)
    return out


def upload_percent(loaded: Column, total: Column) -> Column:
    return F.when(total > 0, _half_up(loaded / total * 100).cast("long"))


def cookie_value(header: Column, name: str) -> Column:
    """The first value of the cookie in a Cookie header; null without one."""
    pairs = F.filter(F.split(header, ";"), lambda p: F.contains(p, F.lit("=")) & (trim_white(F.substring_index(p, "=", 1)) == name))
    first = F.get(pairs, F.lit(0))
    return trim_white(F.substr(first, F.instr(first, "=") + 1))


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), trim_white), lambda v: v != "")


def parse_flag(x: Column) -> Column:
    """Boolean of 1/true/yes/on and 0/false/no/off; null for anything else."""
    word = ascii_lower(trim_white(x))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)


def parse_count(x: Column) -> Column:
    """A non-negative integer, else null."""
    word = trim_white(x)
    return F.when(word.rlike(r"\A\+?[0-9]+\z"), word.try_cast("decimal(20,0)"))
