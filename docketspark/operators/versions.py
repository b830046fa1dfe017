"""Published versions (additional: from the specification of later blocks).

A publication is an immutable snapshot and one entry of an append-only log; the last entry is the pointer. Entries
are created without overwriting, so of two runs that publish at once one takes the next number and the other looks
again. A run whose input revision is not newer than the published one is blocked. Readers name a version and see its
snapshot only, whatever is published meanwhile.

`current_versions` and `version_as_of` say the same of histories in tables: which publications took effect, and which
version held at a given time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Blocked(Exception):
    """The run's input is not newer than what is published."""


class VersionLog:
    """The versions below root, a folder that driver and executors share. Entry creation is as atomic as the file system's create without overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """The log from its first entry on; an entry that is still being written counts as not there."""
        out: list[dict] = []
        while True:
            at = self.path(f"{self.root}/log/{len(out) + 1:012d}.json")
            if not self.fs.exists(at):
                return out
            stream = self.fs.open(at)
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            try:
                out.append(json.loads(raw))
            except ValueError:
                return out

    def _append(self, number: int, entry: dict) -> bool:
        at = self.path(f"{self.root}/log/{number:012d}.json")
        try:
            stream = self.fs.create(at, False)
        except Exception as e:  # whoever was first has the number
            if self.fs.exists(at):
                return False
            raise e
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        return True

    def publish(self, tables: dict[str, DataFrame], revision: int) -> int:
        """Writes the tables as one snapshot and switches the pointer to it; returns the version. Blocked if a run of the same or a newer input revision was published, also while this one wrote."""
        folder = f"{self.root}/snapshots/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        while True:
            log = self.entries()
            newest = max([e["revision"] for e in log if e["kind"] == "published"], default=None)
            if newest is not None and revision <= newest:
                self.fs.delete(self.path(folder), True)
                raise Blocked(f"input revision {revision} is not newer than {newest}")
            if self._append(len(log) + 1, {"kind": "published", "revision": revision, "folder": folder, "tables": sorted(tables)}):
                return len(log) + 1

    def revoke(self, version: int) -> None:
        """No read of the version works from now on."""
        while True:
            log = self.entries()
            if version < 1 or version > len(log) or log[version - 1]["kind"] != "published":
                raise ValueError(f"no version {version}")
            if version in {e.get("version") for e in log} or self._append(len(log) + 1, {"kind": "revoked", "version": version}):
                return

    def statuses(self) -> dict[int, str]:
        """published, superseded or revoked of each version. Revoking the newest does not bring an older one back."""
        log = self.entries()
        revoked, versions = {e["version"] for e in log if e["kind"] == "revoked"}, [i for i, e in enumerate(log, 1) if e["kind"] == "published"]
        return {v: "revoked" if v in revoked else "published" if v == versions[-1] else "superseded" for v in versions}

    def current(self) -> int | None:
        return next((v for v, s in self.statuses().items() if s == "published"), None)

    def read(self, version: int, name: str) -> DataFrame:
        """A table of the pinned version, superseded ones too; a revoked or unknown version is an error."""
        if self.statuses().get(version) not in ("published", "superseded"):
            raise ValueError(f"version {version} can't be read")
        return self.spark.read.parquet(f"{self.entries()[version - 1]['folder']}/{name}")


def current_versions(publications: DataFrame) -> DataFrame:
    """scope, version, from, until, revoked_at of the publications (scope, version, revision, at, revoked_at) that took effect: those with a larger revision than all before them. Equal times go by version; until is the next one's time, null for the newest."""
    by_time = Window.partitionBy("scope").orderBy("at", "version")
    before = F.max("revision").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    taken = publications.where("scope is not null and at is not null and revision is not null").withColumn("_before", before).where("_before is null or revision > _before")
    return taken.select("scope", "version", F.col("at").alias("from"), F.lead("at").over(by_time).alias("until"), "revoked_at")


def version_as_of(requests: DataFrame, publications: DataFrame, last) -> DataFrame:
    """requests (scope, at and more) with version: the one current at that time, null if none was, or if it was revoked by then.

    Validity is cut at midnight, so scope and day are an equal key: a scope with very many requests is split by the
    skewed join, and meets only the versions of that day. last: a time after all requests, for versions without an end.
    """
    spans = current_versions(publications)
    end = F.coalesce("until", F.lit(last).cast("timestamp"))
    days = F.sequence(F.to_date("from"), F.greatest(F.to_date(end), F.to_date("from")))
    spans = spans.select("scope", "version", "from", end.alias("end"), "revoked_at", F.explode(days).alias("_day")).withColumnRenamed("scope", "_scope")
    held = (F.col("scope") == F.col("_scope")) & (F.to_date("at") == F.col("_day")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("end"))
    live = F.when(F.col("revoked_at").isNull() | (F.col("at") < F.col("revoked_at")), F.col("version"))
    return requests.join(spans, held, "left").select(*[requests[c] for c in requests.columns], live.alias("version"))
