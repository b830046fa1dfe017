"""Secret scans over an incremental blob ledger.

Every text version is a blob, named by its SHA-256. The ledger is a Parquet table of (digest, findings) with a
folder for each rule_version; a scan takes only the pairs it doesn't have, once each however many paths hold the blob, appends their
findings, and joins the ledger back to all paths.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, shared_path

by_value(__name__)

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----")
#: A key's body without an END line: header lines, lines of base64 alone and longer runs of it, also quoted or with \\n for line ends.
_BODY = re.compile(r"""(?:(?:[\x20\t\r\n>"',]|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n"'\\]|\Z))|[A-Za-z0-9+/=]{16,}+))*+""")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: Told by the rules themselves, so findings of other rules are never taken for these.
RULE_VERSION = zlib.crc32(repr([p.pattern for p in (_ASSIGN, _ACCESS, _HEX, _PEM, _BODY, _JWT)] + [_WORDS]).encode()) >> 1
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def _keys(text: str) -> list[tuple[str, int, int]]:
    """Private keys from the BEGIN line through the matching END line, or through the body if the next key or the text's end comes first."""
    heads, out = list(_PEM.finditer(text)), []
    for m, limit in zip(heads, [h.start() for h in heads[1:]] + [len(text)], strict=True):
        foot = f"-----END {m[1]}-----"
        at = text.find(foot, m.end(), limit)
        out.append(("pem", m.start(), at + len(foot) if at >= 0 else _BODY.match(text, m.end(), limit).end()))
    return out


def scan(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Cheap byte searches rule out most texts first."""
    low, found, text = raw.lower(), [], None
    if any(w in low for w in _WORDS):
        text = raw.decode("utf-8", "replace")
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        text = text or raw.decode("utf-8", "replace")
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_HEX_BYTES):
        text = text or raw.decode("utf-8", "replace")
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if b"-----BEGIN " in raw:
        text = text or raw.decode("utf-8", "replace")
        found += _keys(text)
    if b"eyJ" in raw:
        text = text or raw.decode("utf-8", "replace")
        found += [("jwt", *m.span()) for m in _JWT.finditer(text)]
    order = {k: i for i, k in enumerate((*KINDS, "pem", "jwt"))}
    return sorted(found, key=lambda f: (f[1], order[f[0]]))


def _scanned(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in scan(t)] for t in b.column("_sc_text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_sc_digest"), pa.array(found, kind)], names=["digest", "findings"])


def digest(text="text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def update_ledger(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scans the blobs of docs that the ledger lacks for this rule version; returns the ledger's rows of that version.

    The rules in force are those of this module, and so is the version; one given by hand starts afresh. The rows
    appended are keyed, so an append that is done twice changes no result: findings are read by key.
    """
    spark = docs.sparkSession
    blobs = docs.select(digest().alias("_sc_digest"), F.coalesce("text", F.lit("")).alias("_sc_text"))
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    once = blobs.groupBy("_sc_digest").agg(F.first("_sc_text").alias("_sc_text"))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # Not an anti join: Spark would put that below the grouping, and every copy of a text would move.
        seen = _read(spark, ledger, rule_version).select(F.col("digest").alias("_sc_digest"), F.lit(True).alias("_sc_seen"))
        once = once.join(seen, "_sc_digest", "left").where("_sc_seen is null").select("_sc_digest", "_sc_text")
    found = once.mapInArrow(_scanned, f"digest binary, findings {FINDINGS}")
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    return _read(spark, ledger, rule_version)


def _read(spark, ledger: str, rule_version: int) -> DataFrame:
    rows = spark.read.schema(f"digest binary, findings {FINDINGS}, rule_version int").parquet(ledger)
    return rows.where(F.col("rule_version") == rule_version)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """docs with findings: array of (kind, start, end), code points, end exclusive, by start and then kind.

    ledger: the ledger's path; without one a new one is made in the shared folder. Null texts count as empty
    and have no findings; kinds may overlap each other; repeated rows and copies get the same findings from one
    scan; an empty table gives an empty result. An input column named findings is replaced.
    """
    docs = docs.drop("findings")
    ledger = ledger or shared_path(docs.sparkSession, "secret-ledger")
    rows = update_ledger(docs, ledger, rule_version)
    hits = rows.where(F.size("findings") > 0).select(F.col("digest").alias("_sc_digest"), "findings").dropDuplicates(["_sc_digest"])
    out = docs.withColumn("_sc_digest", digest()).join(hits, "_sc_digest", "left")
    return out.select(*docs.columns, F.coalesce("findings", F.from_json(F.lit("[]"), FINDINGS)).alias("findings"))


def redacted(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with every finding's characters replaced by mask (overlapping findings by one) and n_chars, if there, made right."""
    out = scan_secrets(docs, **options)

    def step(acc, f):
        return F.struct(
            F.when(f["start"] < acc["end"], acc["text"]).otherwise(F.concat(acc["text"], F.substr("text", acc["end"] + 1, f["start"] - acc["end"]), F.lit(mask))).alias("text"),
            F.greatest(acc["end"], f["end"]).alias("end"),
        )

    clean = F.aggregate("findings", F.struct(F.lit("").alias("text"), F.lit(0).alias("end")), step, lambda a: F.concat(a["text"], F.substr("text", a["end"] + 1)))
    out = out.withColumn("text", F.when(F.size("findings") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
