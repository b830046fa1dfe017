"""What several operators share: word rule, shared folders, small column helpers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.session import shared_path, shared_root

#: Words and the white space between them (ASCII only, as the contracts fix).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def by_value(module: str) -> None:
    """Workers get the module's functions with the tasks, so the package need not be installed on them."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it from there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes the shared tables behind frames of stored() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.toString().split(":", 1)[-1].lstrip("/").startswith(shared_root(spark).split(":", 1)[-1].lstrip("/")):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often a lambda inside body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_key(column) -> Column:
    """A text key without nulls, equal for equal values, with null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column) if isinstance(column, str) else column), F.lit("-"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(findings: Column) -> Column:
    """kind:start:end of each of an array of (kind, start, end), comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
