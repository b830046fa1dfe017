"""Tables of Parquet files, read with explicit schemas where the engine owns them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketspark import schemas as S
from docketspark.functions import validation as V
from docketspark.session import drop_stored, stored_table


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{name}")


#: Tables whose rows are checked before they are written, where they have the engine's columns.
CHECKS = {"materials": (S.MATERIALS, V.material_error), "jobs": (S.JOBS, V.job_error), "sessions": (S.SESSIONS, V.session_error)}


class CheckFailed(ValueError):
    pass


def checked(df: DataFrame, name: str) -> DataFrame:
    """df, all of whose rows pass the table's checks; otherwise an error, and nothing is written. The rows are read twice."""
    schema, error = CHECKS.get(name, (None, None))
    if schema and set(schema.names) <= set(df.columns):
        bad = df.where(error().isNotNull()).count()
        if bad:
            raise CheckFailed(f"{bad} rows fail the checks of {name}")
    return df


def write_table(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> None:
    """Replaces the table with rows that pass its checks. Partitioned by the tenant, a scoped read prunes to its folder."""
    df = checked(df, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{name}")


#: Parts of a tenant's rows in a bucketed table.
BUCKETS = 64
BUCKET = "_bucket"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, root: str, name: str, tenant: str, key: str, buckets: int = BUCKETS) -> None:
    """Replaces the table, with a folder for each tenant and bucket of its keys, one file in each."""
    rows = checked(df, name).withColumn(BUCKET, _bucket(key, buckets))
    rows.repartition(tenant, BUCKET).write.mode("overwrite").partitionBy(tenant, BUCKET).parquet(f"{root}/{name}")


def update_bucketed(spark: SparkSession, root: str, name: str, tenant: str, key: str, keys: DataFrame, transition, buckets: int = BUCKETS) -> DataFrame:
    """Applies a transition to the buckets of keys (tenant, key) alone and replaces their folders; returns what it wrote.

    transition: all rows of those buckets as a frame to the rows after it; rows may change, come and go, but stay in
    their buckets. Other buckets are neither read nor written. The new rows are stored first, so that a run that fails
    before the last write leaves the table as it was. A bucket that loses all its rows is an error, as replacing
    folders would leave it: write the table anew then.
    """
    schema = spark.read.parquet(f"{root}/{name}").schema
    touched = stored_table(keys.select(tenant, _bucket(key, buckets).alias(BUCKET)).where(F.col(tenant).isNotNull()).distinct(), "touched")
    old = spark.read.schema(schema).parquet(f"{root}/{name}").join(touched, [tenant, BUCKET], "left_semi")
    new = stored_table(transition(old.drop(BUCKET)).withColumn(BUCKET, _bucket(key, buckets)), "updated")
    checked(new, name)
    places = lambda df: df.select(tenant, BUCKET).distinct()
    lost, strange = places(old).join(places(new), [tenant, BUCKET], "left_anti"), places(new).join(touched, [tenant, BUCKET], "left_anti")
    if not lost.isEmpty() or not strange.isEmpty():
        raise ValueError("a transition must leave rows in each of its buckets and stay within them")
    writer = new.repartition(tenant, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(tenant, BUCKET).parquet(f"{root}/{name}")
    drop_stored(touched)
    return new.drop(BUCKET)


def read_bucketed(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop(BUCKET)


def test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
