"""Tenant scope: the one way to a tenant's rows. A semantic reproduction, not a security boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant(bureau_id: str | None) -> Column:
    """The tenant's id; null for none or an empty one."""
    return F.nullif(F.lit(bureau_id).cast("string"), F.lit(""))


def tenant_scope(df: DataFrame, bureau_id: str | None, column: str = "bureau_id") -> DataFrame:
    """Rows of the tenant; none at all without one (the comparison with null folds to an empty relation)."""
    return df.where(F.col(column) == tenant(bureau_id).cast(df.schema[column].dataType))


def foreign_rows(df: DataFrame, bureau_id: str | None, column: str = "bureau_id") -> DataFrame:
    """Rows that may not be written under the tenant; a write needs this to be empty."""
    return df.where(~F.coalesce(F.col(column) == tenant(bureau_id).cast(df.schema[column].dataType), F.lit(False)))


def bureau_by_slug(bureaus: DataFrame, slug: str) -> DataFrame:
    return bureaus.where(F.col("slug") == slug).select("id")
