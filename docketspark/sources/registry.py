"""Bulk import of registries from XML parts (additional: from the specification of later blocks).

Parts are imported in batches. A batch's rows are written first, good and broken ones apart, then its entry in the ledger
of parts; only entries make rows visible, so an import that ends anywhere is resumed by running it again, and parts
that the ledger has (same path, length and time of change) are never read twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of XML in a batch, at least one part.
BATCH_BYTES = 64 << 30
CORRUPT, PART, CHANGED = "_corrupt", "_part", "_changed"
LEDGER = "path string, length long, modified timestamp, n_rows long, n_broken long, n_lost long"


def _parts(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    """path, length and modified of the parts in a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _clean(path: str) -> Column:
    """Local paths are told with one slash or with three."""
    return F.regexp_replace(path, "^file:/+", "/")


def _committed(spark: SparkSession, root: str) -> list[str]:
    """Batches whose ledger entry is whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified, n_rows, n_broken and n_lost (records that are opened but don't end) of every part imported."""
    paths = [f"{root}/ledger/{b}" for b in _committed(spark, root)]
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def _import_batch(spark: SparkSession, root: str, parts: list, opening: str, end: str, schema: T.StructType, key: str) -> None:
    name = hashlib.sha256("\n".join(f"{p.path}:{p.length}:{p.modified}" for p in parts).encode()).hexdigest()[:32]
    paths = [p.path for p in parts]
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # A record runs from its opening to its end tag, so one that is broken doesn't spoil its neighbours, and parts can be split.
    pieces = spark.read.option("lineSep", opening).text(paths).select("value", F.col("_metadata.file_path").alias(PART), F.col("_metadata.file_modification_time").alias(CHANGED))
    ended = pieces.where(F.instr("value", end) > 0)
    body = F.concat(F.lit(opening), F.substring_index("value", end, 1), F.lit(end))
    record = F.from_xml(body, wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = ended.select(record.alias("_x"), body.alias("_body"), PART, CHANGED)
    broken = F.col("_x").isNull() | F.col(f"_x.{CORRUPT}").isNotNull() | F.col(f"_x.{key}").isNull()
    rows = rows.select(*[F.col("_x").getField(f.name).alias(f.name) for f in schema.fields], F.when(broken, F.col("_body")).alias(CORRUPT), PART, CHANGED, broken.alias("broken"))
    rows.write.mode("overwrite").partitionBy("broken").parquet(f"{root}/rows/{name}")
    stored = _batch_rows(spark, root, [name], schema).groupBy(F.col(PART).alias("_p")).agg(F.count("*").alias("n"), F.count_if("broken").alias("b"))
    # What stands before the first record is no piece of one.
    opened = pieces.groupBy(F.col(PART).alias("_o")).agg((F.count("*") - 1).alias("opened"))
    entry = spark.createDataFrame([(p.path, p.length, p.modified) for p in parts], "path string, length long, modified timestamp")
    entry = entry.join(stored, _clean("path") == _clean("_p"), "left").join(opened, _clean("path") == _clean("_o"), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    entry = entry.select("path", "length", "modified", n.alias("n_rows"), F.coalesce("b", F.lit(0).cast("long")).alias("n_broken"), F.greatest(F.coalesce("opened", F.lit(0).cast("long")) - n, F.lit(0)).alias("n_lost"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/{name}")


def import_registry(spark: SparkSession, source: str, root: str, opening: str, end: str, schema: T.StructType, key: str, batch_bytes: int = BATCH_BYTES, batches: int | None = None, pattern: str = "*.xml") -> int:
    """Imports the parts of source (files of pattern) that root's ledger lacks, in order of path; returns how many batches it ran.

    opening and end: the texts that a record begins and ends with, such as "<Doc>" or "<Doc " and "</Doc>"; records don't
    hold each other. schema: its fields; key: the one that must not be null. Records that aren't well-formed or don't fit
    the schema are kept as broken; those without an end are counted. Parts are UTF-8. A part that changed since it was imported is
    imported again and takes the place of what it held. batches: at most so many, then it returns.

    The names of the parts are on the driver, as they are in Spark's own file index; their contents never are.
    """
    seen = ledger(spark, root).select("path", "length", "modified")
    todo = _parts(spark, source, pattern).join(seen, ["path", "length", "modified"], "left_anti").orderBy("path").collect()
    ran = 0
    while todo and (batches is None or ran < batches):
        take, size = 1, todo[0].length
        while take < len(todo) and size + todo[take].length <= batch_bytes:
            size += todo[take].length
            take += 1
        _import_batch(spark, root, todo[:take], opening, end, schema, key)
        todo, ran = todo[take:], ran + 1
    return ran


def _batch_rows(spark: SparkSession, root: str, names: list[str], schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in (CORRUPT, PART)), T.StructField(CHANGED, T.TimestampType()), T.StructField("broken", T.BooleanType())])
    frames = [spark.read.schema(whole).option("basePath", f"{root}/rows/{n}").parquet(f"{root}/rows/{n}") for n in names]
    out = spark.createDataFrame([], whole)
    for f in frames:
        out = out.unionByName(f)
    return out


def _current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of the last state of every part."""
    last = ledger(spark, root).groupBy(_clean("path").alias("_path")).agg(F.max("modified").alias("_last"))
    rows = _batch_rows(spark, root, _committed(spark, root), schema)
    return rows.join(last, (_clean(PART) == F.col("_path")) & (F.col(CHANGED) == F.col("_last"))).drop("_path", "_last")


def registry(spark: SparkSession, root: str, schema: T.StructType, key: str, latest: str) -> DataFrame:
    """One whole record for each key: that with the greatest `latest`, then of the last path. Equal records of one part count once."""
    rows = _current(spark, root, schema).where("not broken")
    names = [f.name for f in schema.fields]
    # An aggregate, not a window: a key with very many versions is reduced before it moves.
    best = F.max(F.struct(F.col(latest).alias("_a"), F.col(PART).alias("_c"), F.struct(*names).alias("_r")))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best._r.*")


def quarantine(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """part and record of all records set apart."""
    return _current(spark, root, schema).where("broken").select(F.col(PART).alias("part"), F.col(CORRUPT).alias("record"))
