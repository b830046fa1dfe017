"""WARC archives with revisit resolution.

Only headers (page, digest, length) are shuffled by payload digest to tell responses from revisits; the payloads
then move once, by page, to the tasks that write the archives, whose records all get fresh headers. Reading
streams the archives record by record and joins revisits to the responses they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, forget, shared_path, stored

by_value(__name__)

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
DATE = "2025-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_READ = 1 << 20


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    """A header value keeps to one line."""
    return " ".join(value.split())


def _target(page_id, url) -> str:
    return _line(url) if url and url.strip() else f"urn:page:{page_id}"


def _member(head: list[str], body: bytes) -> bytes:
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def info(name: str, date: str = DATE) -> bytes:
    """The member at the head of an archive file."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: docketspark\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url, payload: bytes, digest: str, original, date: str = DATE, original_url=None) -> bytes:
    """One gzip member holding the record; original, original_url: the response's page_id and url if it is a revisit."""
    named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = original is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_target(page_id, url)}", f"WARC-Payload-Digest: {named}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Target-URI: {_target(original, original_url)}", f"WARC-Refers-To-Date: {date}"]
    return _member(head, _HTTP if revisit else _HTTP + payload)


def members(stream):
    """The gzip members of a stream, each unpacked; memory is bounded by the largest record."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(_READ):
        while data:
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(parts)
                data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("the archive ends inside a record")


def parsed(raw: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, digest and n (bytes of the payload) of each row, stored."""
    heads = pages.select("page_id", "url", _payload().alias("p")).select("page_id", "url", F.sha1("p").alias("digest"), F.octet_length("p").alias("n"))
    return stored(heads, "warc-heads")


def resolved_headers(heads: DataFrame) -> DataFrame:
    """page_id, digest, refers_to and its url of each page_id and digest that revisits, from headers alone."""
    first = heads.where(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("o"))
    first = first.select("digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"))
    joined = heads.join(first, "digest", "left")
    refers = F.when(F.col("original") != F.coalesce(F.col("page_id"), F.col("original") - 1), F.col("original"))
    return joined.select("page_id", "digest", refers.alias("refers_to"), "original_url").where("refers_to is not null").distinct()


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files into folder, a URI that all executors share; returns path and records of each.

    Of equal payloads of LEAST_BYTES or more, that with the largest page_id is the response and the others
    revisit it. A file is written under a name of its task's own and then renamed, so that a task that is run again
    replaces its file by an equal one.
    """
    heads = headers(pages)
    revisits = resolved_headers(heads).select(F.col("page_id").alias("_w_page"), F.col("digest").alias("_w_digest"), "refers_to", "original_url")
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_w_page")) & (F.col("digest") == F.col("_w_digest")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "refers_to", "original_url")

    def written(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, n, out = f"archive-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        for b in batches:
            if b.num_rows and out is None:
                out = fs.open_output_stream(draft, compression=None)
                out.write(info(name, date))
            for i in range(b.num_rows):
                page, url, payload, digest, original, original_url = (b.column(c)[i].as_py() for c in range(6))
                out.write(record(page, url, payload or b"", digest, original, date, original_url))
                n += 1
        if out is not None:
            out.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    manifest = stored(rows.mapInArrow(written, "path string, records long"), "warc-manifest")
    forget(heads)
    return manifest


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, url, record_type, digest (hex), payload_bytes and payload (null for revisits) of every record of files (path).

    The digest of a response is computed from its payload and must be that of its header.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def rows(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                found, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for fields, block in map(parsed, members(stream)):
                        kind, page = fields["warc-type"], fields.get("x-page-id")
                        if kind not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{fields['warc-record-id']}: payload differs from its digest")
                        found.append({"page_id": page and int(page), "url": fields.get("warc-target-uri"), "record_type": kind, "digest": digest, "payload_bytes": None if payload is None else len(payload), "payload": payload})
                        held += len(block)
                        if held > 8 * _READ:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                yield pa.RecordBatch.from_pylist(found, schema)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(rows, "page_id long, url string, record_type string, digest string, payload_bytes long, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits joined to the responses they repeat."""
    heads = stored(records.select("page_id", "record_type", "digest", "payload_bytes"), "warc-records")
    full = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= LEAST_BYTES))
    full = full.groupBy("digest").agg(F.max("page_id").alias("original"), F.max("payload_bytes").alias("n"))
    joined = heads.join(full, "digest", "left")
    again = F.col("record_type") == "revisit"
    return joined.select("page_id", F.when(again, F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.when(again, F.col("original")).alias("refers_to"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as archives, reads them back and resolves the revisits; a row for each row of pages.

    Null html is an empty payload; payloads below LEAST_BYTES are responses whatever they equal; rows equal in
    page_id and payload are all of one kind; a null page_id revisits but is never revisited unless all are null,
    and then all are responses; null and blank urls become urn:page:<page_id>. An empty table gives an empty
    result. Extra columns don't matter.
    """
    spark: SparkSession = pages.sparkSession
    return resolve(read_archives(write_archives(pages, folder or shared_path(spark, "warc"))))
