import pytest
from pyspark.sql import functions as F

from docketspark.functions import scalars as X
from docketspark.functions import validation as V

DIGEST = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
NIL = "00000000-0000-0000-0000-000000000000"


def check(spark, cases, column, kind="string"):
    """cases: (input, expected); column: Column -> Column."""
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], f"i int, x {kind}")
    got = [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]
    assert got == [c[1] for c in cases]


PDF, PNG, JPEG = "application/pdf", "image/png", "image/jpeg"


def test_signatures(spark):
    cases = [
        (b"%PDF-1.7\n%...", PDF), (b"\x89PNG\r\n\x1a\n\x00", PNG), (b"\xff\xd8\xff\xe0\x00\x10", JPEG), (b"PK\x03\x04rest", None),
        (b"<html><body>hi", None), (b"junk%PDF-1.4", None), (b"%PD", None), (b"", None), (b"\xff\xd8\xff", None), (None, None),
    ]
    check(spark, cases, X.detect_media_type, "binary")


def test_declared_types(spark):
    check(spark, [("application/pdf", PDF), ("IMAGE/JPEG; charset=binary", JPEG), (" application/x-pdf ;a", PDF), ("image/jpg", JPEG), ("application/octet-stream", None), ("", None), (None, None)], X.parse_media_type)


def test_media_conflict(spark):
    pdf = lambda x: X.media_conflict(x, F.lit(PDF))
    check(spark, [("image/png", "unsupported_media_type"), ("application/pdf", None), ("text/plain", None), (None, None)], pdf)


def test_names(spark):
    cases = [("  BASIS  ", None), ("", "validation_failed"), ("   ", "validation_failed"), ("a" * 200, None), ("a" * 201, "validation_failed"), ("\0name", "validation_failed"), ("\u3000\u2003", "validation_failed"), (None, "validation_failed"), ("a\u0085b", "validation_failed")]
    check(spark, cases, V.name_error)
    check(spark, [("  BASIS  ", "BASIS"), ("\u00a0x\u2028", "x")], V.clean_name)


def test_notes(spark):
    cases = [(None, None), ("  ", None), ("n" * 10_000, None), ("n" * 10_001, "validation_failed"), ("line\nbreak\tok", None), ("bell\x07", "validation_failed"), ("cr\rx", "validation_failed")]
    check(spark, cases, V.note_error)
    check(spark, [("  ", None), (" hi ", "hi"), (None, None)], V.clean_note)


def test_display_filename(spark):
    cases = [
        ("../../etc/passwd", "passwd"), ("C:\\Windows\\System32\\catalog.pdf", "catalog.pdf"), ("..", "upload.pdf"), ("   ", "upload.pdf"), ("", "upload.pdf"),
        ("bad\0name.pdf", "bad name.pdf"), ("каталог.pdf", "каталог.pdf"), ("x" * 500 + ".pdf", "x" * 200), ("a/", "upload.pdf"), (" .hidden. ", "hidden"),
    ]
    check(spark, cases, lambda x: X.display_filename(x, F.lit(PDF)))


def test_disposition(spark):
    check(spark, [("привет", "original.png"), ('катало"г.pdf', "________.pdf"), ("a b.pdf", "a b.pdf"), ("", "original.png")], lambda x: X.disposition_ascii(x, F.lit(PNG)))
    check(spark, [("a b.pdf", "UTF-8''a%20b.pdf"), ("~*+é", "UTF-8''~%2A%2B%C3%A9")], X.disposition_utf8)


def test_keys(spark):
    key = f"bureau-{NIL}/partner-{NIL}/9f/{DIGEST}"
    check(spark, [(DIGEST, key), (DIGEST.upper(), None), ("abc", None), ("../../etc/passwd", None)], lambda x: X.object_key(F.lit(NIL), F.lit(NIL), x))
    bad = ["../../../etc/passwd", "bureau-x/partner-y/aa/bb", key.replace("/9f/", "/../"), key[:-64] + "z" * 64, "/" + key, key.replace("/9f/", "/ab/"), key + "\n", key.upper()]
    check(spark, [(key, DIGEST), *[(b, None) for b in bad]], lambda x: X.parse_key(x)["digest"])


def test_states(spark):
    check(spark, [("failed", True), ("partial", True), ("queued", False), ("processing", False), ("completed", False), ("quarantined", False)], X.can_retry)
    check(spark, [("quarantined", "quarantined material cannot be retried")], X.retry_refusal)
    with pytest.raises(Exception, match="unknown job status: lost"):
        spark.range(1).select(X.checked_enum(F.lit("lost"), ("queued",), "job status")).collect()


def test_bytes_and_percent(spark):
    check(spark, [(512, "512 Б"), (1536, "1.5 КиБ"), (25 * 1024 * 1024, "25 МиБ"), (-1, "—"), (0, "0 Б"), (1024, "1 КиБ"), (1 << 40, "1024 ГиБ"), (None, "—")], X.format_bytes, "long")
    check(spark, [(0, None), (200, 25), (3, 1667)], lambda x: X.upload_percent(F.lit(50), x), "long")


def test_small_texts(spark):
    check(spark, [("a=1; sid = x ; sid=y", "x"), ("sid", None), ("other=1", None), ("sid=", "")], lambda h: X.cookie_value(h, "sid"))
    check(spark, [("a, b,,c ", ["a", "b", "c"]), ("", [])], X.csv_list)
    check(spark, [(" YES ", True), ("off", False), ("2", None)], X.parse_flag)
    check(spark, [("12", 12), ("-1", None), ("1.5", None)], lambda x: X.parse_count(x).cast("long"))
    check(spark, [("a.jpeg", "JPE"), ("a", "PDF"), ("a.", "PDF")], lambda x: X.extension_label(x, F.lit(PDF)))
    check(spark, [("rate_limited", 429), ("x", None)], X.http_status)
    check(spark, [(0, "validation_failed"), (26_214_400, None), (26_214_401, "payload_too_large")], V.file_size_error, "long")


def test_ranges():
    for bad in (None, 59, 604_801):
        with pytest.raises(ValueError):
            V.in_range(bad, 60, 604_800, "session ttl")
    assert V.in_range(60, 60, 604_800, "session ttl") == 60
