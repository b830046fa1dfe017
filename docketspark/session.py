"""A session with the settings that the operators assume, and the folder that its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(name: str = "docketspark", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive plans; conf overrides or adds settings (dots as double underscores)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir. One of our own where that is unset and everything runs in one process; on a cluster it must be set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = context._jsc.sc().getCheckpointDir()
        root = there.get() if there.isDefined() else None
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docketspark-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored_table(df, name: str):
    """df written as Parquet in the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df) -> None:
    """Deletes the folder behind a frame of stored_table() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
