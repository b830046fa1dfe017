"""Batch intake: uploads are checked, typed, hashed, deduplicated and turned into materials and jobs.

Rejected requests are rows with an error_code, not exceptions. Publishing two tables is two frames from one input;
their agreement is a check (job_gaps), as Spark has no transaction over tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark import schemas as S
from docketspark.functions.scalars import detect_media_type, display_filename, idempotency_key, media_conflict, object_key, sha256_hex
from docketspark.functions.validation import file_size_error


def uuid_of(*parts: Column) -> Column:
    """A stable identifier from parts, so that a batch that runs again makes the same rows."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def first_over_limit(chunks: DataFrame, limit: int, keys: list[str], order: list[str], size: str) -> DataFrame:
    """chunks with upto (bytes so far) and over: whether this chunk is the first beyond limit; exactly limit is allowed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return chunks.withColumn("upto", upto).withColumn("over", (F.col("upto") > limit) & (F.col("upto") - F.col(size) <= limit))


def receive(parts: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES, other_bytes: int = S.OTHER_FIELDS_MAX_BYTES) -> DataFrame:
    """A row a request: its one file with seq, error_code (null if accepted), media_type, size_bytes, sha256 and display name.

    parts: see schemas.UPLOAD_PARTS, one row a whole part. Exactly one part must be named file; the other parts
    together may have other_bytes bytes. Bytes are typed, measured and hashed where they are read and don't move;
    with_content brings them back for the requests that need them.
    """
    is_file, content = F.col("part_name") == "file", F.col("content")
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    facts = F.struct("seq", "filename", "declared_type", detect_media_type(content).alias("media_type"), size.alias("size_bytes"), sha256_hex(content).alias("sha256"))
    light = parts.select("request_id", "bureau_id", "partner_id", "arrival", is_file.alias("is_file"), size.alias("size"), F.when(is_file, facts).alias("f"))
    one = light.groupBy("request_id", "bureau_id", "partner_id").agg(
        F.count_if("is_file").alias("files"),
        F.coalesce(F.sum(F.when(~F.col("is_file"), F.col("size"))), F.lit(0)).alias("other_bytes"),
        F.min("arrival").alias("arrival"),
        F.min("f").alias("f"),
    )
    one = one.select("request_id", "bureau_id", "partner_id", "arrival", "files", "other_bytes", "f.*").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0).cast("long")))
    error = (
        F.when(F.col("files") != 1, F.lit("validation_failed"))
        .when(F.col("other_bytes") > other_bytes, F.lit("payload_too_large"))
        .when(file_size_error(F.col("size_bytes"), max_bytes).isNotNull(), file_size_error(F.col("size_bytes"), max_bytes))
        .otherwise(media_conflict(F.col("declared_type"), F.col("media_type")))
    )
    one = one.withColumn("error_code", error)
    return one.withColumn("filename", display_filename(F.coalesce("filename", F.lit("")), F.col("media_type"))).drop("files", "other_bytes")


def with_content(received: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of receive() with the content of their file."""
    files = parts.where(F.col("part_name") == "file").select("request_id", "bureau_id", "partner_id", "seq", "content")
    return received.join(files, ["request_id", "bureau_id", "partner_id", "seq"])


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; the group is reduced to its least row before the shuffle."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("_f"))
    return least.select(*keys, "_f.*").select(*rows.columns)


def ingest(received: DataFrame, materials: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, new materials, new jobs) of accepted and rejected requests.

    A partner's equal bytes are one material, the first to arrive (then by request) or the one already there;
    outcomes say created or duplicate for each accepted request and carry the material's id.
    """
    ok = received.where("error_code is null")
    keys = ["bureau_id", "partner_id", "sha256"]
    fields = ["request_id", "arrival", *keys, "filename", "media_type", "size_bytes"]
    first = first_of_each(ok.select(*fields), keys, ["arrival", "request_id"])
    there = materials.select(*keys, F.col("id").alias("old_id"))
    new = first.join(there, keys, "left_anti").withColumn("id", uuid_of(*map(F.col, keys)))
    at = F.col("arrival")
    created = new.select(
        "id", "bureau_id", "partner_id", "filename", "media_type", "size_bytes", "sha256",
        object_key(F.col("bureau_id"), F.col("partner_id"), F.col("sha256")).alias("storage_key"),
        F.lit("queued").alias("status"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("error"), at.alias("created_at"), at.alias("updated_at"),
    )
    owner = new.select(*keys, F.col("request_id").alias("_owner"), F.col("id").alias("new_id"))
    outcomes = received.select("request_id", *keys, "error_code").join(owner, keys, "left").join(there, keys, "left")
    kind = F.when(F.col("error_code").isNotNull(), F.lit("rejected")).when(F.col("_owner") == F.col("request_id"), F.lit("created")).otherwise("duplicate")
    material = F.when(F.col("error_code").isNull(), F.coalesce("old_id", "new_id"))
    outcomes = outcomes.select("request_id", "bureau_id", "partner_id", "error_code", kind.alias("outcome"), material.alias("material_id"))
    return outcomes, created, enqueue(created, jobs)


def enqueue(materials: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs of materials that have none under their idempotency key; enqueuing twice adds nothing."""
    key = idempotency_key(F.lit(S.JOB_KIND[0]), F.col("id"))
    wanted = materials.withColumn("idempotency_key", key).join(jobs.select("bureau_id", "idempotency_key"), ["bureau_id", "idempotency_key"], "left_anti")
    none = F.lit(None).cast("string")
    at = F.col("updated_at")
    return wanted.select(
        uuid_of(F.lit("job"), F.col("bureau_id"), F.col("idempotency_key")).alias("id"), "bureau_id", "partner_id", F.col("id").alias("material_id"),
        F.lit(S.JOB_KIND[0]).alias("kind"), F.lit("queued").alias("status"), none.alias("stage"), F.lit(0).alias("attempts"), F.lit(S.MAX_ATTEMPTS).alias("max_attempts"),
        "idempotency_key", at.alias("run_after"), none.alias("lease_owner"), F.lit(None).cast("timestamp").alias("lease_expires_at"), none.alias("error"), at.alias("created_at"), at.alias("updated_at"),
    ).dropDuplicates(["bureau_id", "idempotency_key"])


def key_gaps(children: DataFrame, parents: DataFrame, on: dict[str, str]) -> DataFrame:
    """Children without their parent; a write needs this to be empty. on: child column -> parent column."""
    p = parents.select(*[F.col(v).alias(f"_p{i}") for i, v in enumerate(on.values())])
    cond = [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(on)]
    return children.join(p, cond, "left_anti")


def job_gaps(materials: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(materials without a job, jobs without a material); both are empty after ingest."""
    return key_gaps(materials, jobs, {"bureau_id": "bureau_id", "id": "material_id"}), key_gaps(jobs, materials, {"bureau_id": "bureau_id", "material_id": "id"})
