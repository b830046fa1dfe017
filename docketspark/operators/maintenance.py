"""Maintenance: orphaned objects, stale staging files, and the report of a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.scalars import parse_key
from docketspark.operators.transitions import purge_sessions, reclaim_expired_leases, seconds

STAGING_SECONDS, SCAN_LIMIT = 3_600, 5_000


def orphans(objects: DataFrame, materials: DataFrame, bureau_id: str | None) -> DataFrame:
    """Objects (key) of the bureau that no material of their partner knows by digest; reported, never deleted."""
    keyed = objects.withColumn("_k", parse_key(F.col("key"))).where(F.col("_k.bureau_id") == F.lit(bureau_id))
    known = materials.select(F.col("bureau_id").alias("_b"), F.col("partner_id").alias("_p"), F.col("sha256").alias("_d"))
    on = (F.col("_k.bureau_id") == F.col("_b")) & (F.col("_k.partner_id") == F.col("_p")) & (F.col("_k.digest") == F.col("_d"))
    return keyed.join(known, on, "left_anti").drop("_k")


def stale_staging(files: DataFrame, as_of: Column, age_seconds: int = STAGING_SECONDS) -> DataFrame:
    """Staging files (path, modified, length) as old as age_seconds or older."""
    return files.where(F.col("modified") <= as_of - seconds(age_seconds))


def staging_totals(stale: DataFrame) -> DataFrame:
    return stale.agg(F.count("*").alias("removed"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("removed_bytes"))


def maintenance_report(sessions: DataFrame, jobs: DataFrame, staging: DataFrame, listing: DataFrame, truncated: bool, materials: DataFrame, bureau_id: str | None, idle_seconds: int, as_of: Column) -> DataFrame:
    """One row: purged, reclaimed, removed, removed_bytes, scanned, orphans, truncated. listing: the objects scanned, of all bureaus."""
    one = purge_sessions(sessions, idle_seconds, as_of)[1]
    one = one.crossJoin(reclaim_expired_leases(jobs, bureau_id, as_of)[1]).crossJoin(staging_totals(stale_staging(staging, as_of)))  # one row each
    one = one.crossJoin(listing.agg(F.count("*").alias("scanned"))).crossJoin(orphans(listing, materials, bureau_id).agg(F.count("*").alias("orphans")))
    return one.withColumn("truncated", F.lit(truncated))
