"""Tenant-scoped listing, lookup, existence and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark import schemas as S
from docketspark.functions.scalars import checked_enum
from docketspark.operators.tenancy import tenant_scope


def newest_first(df: DataFrame, at: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc_nulls_last())


def list_partners(partners: DataFrame, bureau_id: str | None) -> DataFrame:
    return newest_first(tenant_scope(partners, bureau_id).select(*S.PARTNER_COLUMNS))


def get_partner(partners: DataFrame, bureau_id: str | None, partner_id: str) -> DataFrame:
    """No or one row."""
    return tenant_scope(partners, bureau_id).where(F.col("id") == partner_id).select(*S.PARTNER_COLUMNS)


def partner_exists(partners: DataFrame, bureau_id: str | None, partner_id: str) -> DataFrame:
    """One row: found (boolean). The probe stops at the first match."""
    hit = tenant_scope(partners, bureau_id).where(F.col("id") == partner_id).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def with_partner(children: DataFrame, partners: DataFrame) -> DataFrame:
    """Children whose partner exists in their tenant."""
    keys = partners.select(F.col("bureau_id").alias("_b"), F.col("id").alias("_p"))
    return children.join(keys, (F.col("bureau_id") == F.col("_b")) & (F.col("partner_id") == F.col("_p")), "left_semi")


def material_statuses(materials: DataFrame) -> DataFrame:
    return materials.withColumn("status", checked_enum(F.col("status"), S.MATERIAL_STATUS, "material status"))


def job_statuses(jobs: DataFrame) -> DataFrame:
    jobs = jobs.withColumn("status", checked_enum(F.col("status"), S.JOB_STATUS, "job status"))
    return jobs.withColumn("kind", checked_enum(F.col("kind"), S.JOB_KIND, "job kind"))


def list_materials(materials: DataFrame, bureau_id: str | None, partner_id: str) -> DataFrame:
    rows = tenant_scope(materials, bureau_id).where(F.col("partner_id") == partner_id)
    return newest_first(material_statuses(rows).select(*S.MATERIAL_COLUMNS))


def get_material(materials: DataFrame, bureau_id: str | None, partner_id: str, material_id: str) -> DataFrame:
    """No or one row, with the internal storage key."""
    rows = tenant_scope(materials, bureau_id).where((F.col("partner_id") == partner_id) & (F.col("id") == material_id))
    return material_statuses(rows).select(*S.MATERIAL_COLUMNS, "storage_key")


def find_by_digest(materials: DataFrame, bureau_id: str | None, partner_id: str, sha256: str) -> DataFrame:
    rows = tenant_scope(materials, bureau_id).where((F.col("partner_id") == partner_id) & (F.col("sha256") == sha256))
    return material_statuses(rows).select(*S.MATERIAL_COLUMNS)


def find_all_by_digest(materials: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bulk form: wanted has bureau_id, partner_id, sha256."""
    return material_statuses(materials.join(wanted.distinct(), ["bureau_id", "partner_id", "sha256"], "left_semi"))


def list_jobs(jobs: DataFrame, bureau_id: str | None, partner_id: str) -> DataFrame:
    rows = tenant_scope(jobs, bureau_id).where(F.col("partner_id") == partner_id)
    return newest_first(job_statuses(rows).select(*S.JOB_COLUMNS))


def count_by_status(jobs: DataFrame, bureau_id: str | None) -> DataFrame:
    """status, total; statuses without rows are absent."""
    return job_statuses(tenant_scope(jobs, bureau_id)).groupBy("status").agg(F.count("*").alias("total"))


def any_pending(materials: DataFrame, *by: str) -> DataFrame:
    """pending (boolean) of each group, or one row for the whole list, false if it is empty."""
    return materials.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("status").isin("queued", "processing")), F.lit(False)).alias("pending"))
