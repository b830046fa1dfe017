"""The content-addressed object store: listing, reading, planning writes, publishing."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketspark.functions.scalars import KEY, parse_key, sha256_hex

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def object_files(spark: SparkSession, root: str) -> DataFrame:
    """path, key (relative to root), length, modified of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", r"\A[a-z0-9]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    base = "/" + base.lstrip("/")
    return files.select("path", F.substr(plain, F.lit(len(base) + 2)).alias("key"), F.col("length"), F.col("modificationTime").alias("modified"))


def bounded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` rows by key, with truncated: whether there are so many. One pass; at most `limit` rows come together."""
    return rows.orderBy(key).limit(max(0, limit)).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) >= limit)


def _folders(prefixes: DataFrame, root: str) -> DataFrame:
    """prefix: the folders right below each prefix, listed by tasks."""

    def below(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for prefix in b.column("prefix").to_pylist():
                there = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{prefix}".rstrip("/"), allow_not_found=True))
                names = [f"{prefix}/{f.base_name}".lstrip("/") for f in there if f.type == pyarrow.fs.FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["prefix"])

    return prefixes.repartition("prefix").mapInArrow(below, "prefix string")


def list_objects(spark: SparkSession, root: str, limit: int) -> DataFrame:
    """key, length, modified, truncated of valid objects by key, at most limit. Other files and folders are skipped.

    Tenants, partners and shards are listed level by level in tasks; shards are dealt in key order, and a task stops
    as soon as it has `limit` valid keys, so no task and no file index holds more. The driver sees no listing.
    """
    shards = spark.createDataFrame([("",)], "prefix string")
    for _ in range(3):
        shards = _folders(shards, root)
    # KEY, whose end of text Python writes otherwise.
    valid = re.compile(KEY.replace(r"\z", r"\Z"), re.ASCII)

    def listed(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        left = limit
        for b in batches:
            for prefix in b.column("prefix").to_pylist() if left > 0 else []:
                if left <= 0:
                    break
                there = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{prefix}", allow_not_found=True))
                files = sorted((f for f in there if f.type == pyarrow.fs.FileType.File and valid.match(f"{prefix}/{f.base_name}")), key=lambda f: f.base_name)[:left]
                left -= len(files)
                columns = [pa.array([f"{prefix}/{f.base_name}" for f in files], pa.string()), pa.array([f.size for f in files], pa.int64()), pa.array([f.mtime for f in files], pa.timestamp("us", tz="UTC"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "length", "modified"])

    keys = shards.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(listed, "key string, length long, modified timestamp")
    return bounded(keys, "key", limit)


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", "content", sha256_hex(F.col("content")).alias("sha256"))


def plan_puts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (key, size_bytes) with action: write, already_present (same size) or replace (another size)."""
    there = existing.select("key", F.col("length").alias("_length"))
    action = F.when(F.col("_length").isNull(), "write").when(F.col("_length") == F.col("size_bytes"), "already_present").otherwise("replace")
    return new.join(there, "key", "left").withColumn("action", action).drop("_length")


def publish(objects: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
    """Writes objects (key, content) below root, a URI all executors share; returns key, size_bytes and action of each.

    A key must end in its content's SHA-256. Every file is written under a name of its own in .staging and then
    renamed to its key, so readers see whole files only and a task that runs again replaces equal bytes. existing
    (key, length; see object_files): what is there already with the right size is left alone. The result is to be
    materialised once.
    """
    digest = parse_key(F.col("key"))["digest"]
    wrong = F.raise_error(F.concat(F.lit("key and content differ: "), F.coalesce("key", F.lit("null"))))
    rows = objects.select("key", F.when(F.coalesce(digest == sha256_hex(F.col("content")), F.lit(False)), F.col("content")).otherwise(wrong).alias("content"), F.octet_length("content").cast("long").alias("size_bytes"))
    rows = rows.withColumn("action", F.lit("write")) if existing is None else plan_puts(rows, existing)

    def put(batches):
        import uuid

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(f"{base}/.staging", recursive=True)
        for b in batches:
            for key, content, action in zip(*(b.column(c).to_pylist() for c in ("key", "content", "action")), strict=True):
                if action == "already_present":
                    continue
                draft = f"{base}/.staging/{uuid.uuid4().hex}"
                with fs.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                fs.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
                fs.move(draft, f"{base}/{key}")
            yield b.select(["key", "size_bytes", "action"])

    return rows.select("key", "content", "size_bytes", "action").mapInArrow(put, "key string, size_bytes long, action string")


def sweep(stale: DataFrame) -> int:
    """Deletes files (path) where they are; deleting a missing one is no error. Returns how many there were."""

    def drop(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                try:
                    fs.delete_file(place)
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return stale.select("path").mapInArrow(drop, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
