"""Conflicting and stale claims (additional: from the specification of later blocks).

A claim says that a property of a subject has a value within [since, until). Claims are never paired: each value's
intervals are first united, so that a running sum of starts and ends counts the different values that hold at any
time. Where that is two or more there is a conflict, and a claim is in conflict if one begins or goes on in its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["subject", "property"]
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _bounded(claims: DataFrame) -> DataFrame:
    since, until = F.coalesce("since", F.lit(FIRST).cast("timestamp")), F.coalesce("until", F.lit(LAST).cast("timestamp"))
    return claims.select("id", *KEY, "value", since.alias("since"), until.alias("until")).where("subject is not null and property is not null and value is not null and since < until")


def united(claims: DataFrame) -> DataFrame:
    """subject, property, value, since, until: each value's overlapping or adjoining intervals made one."""
    w = Window.partitionBy(*KEY, "value").orderBy("since", "until")
    new = F.when(F.col("since") <= F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    island = claims.withColumn("_new", new).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*KEY, "value", "_n").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_n")


def conflicts(claims: DataFrame) -> DataFrame:
    """subject, property, at, values: from time `at` on so many different values hold, as far as the next row. A row a time at which the number changes."""
    one = _bounded(claims)
    ends = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d"))))
    step = united(one).select(*KEY, ends.alias("x")).groupBy(*KEY, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return step.select(*KEY, "at", F.sum("d").over(w).alias("values"))


def statuses(claims: DataFrame, as_of: Column) -> DataFrame:
    """id and status of claims (id, subject, property, value, since, until), a row each.

    unknown: without subject, property or value, or an empty interval; conflicted: another value holds at some time
    of its own; stale: over by as_of; else source_supported. A null since or until is open. Repeated claims and
    equal values don't conflict; an interval that ends when another begins doesn't meet it. Each subject and property
    is one sorted pass over its claims, spilled to disk if long: linear, however many of them overlap.
    """
    levels = conflicts(claims)
    begun = (F.col("values") > 1).cast("int")
    marks = levels.select(*KEY, "at", F.lit(0).alias("kind"), F.lit(None).cast(claims.schema["id"].dataType).alias("id"), "values", begun.alias("begun"))
    ends = F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("kind")))
    probes = _bounded(claims).distinct().select("id", *KEY, F.explode(ends).alias("x")).select(*KEY, "x.at", "x.kind", "id", F.lit(None).cast("long").alias("values"), F.lit(0).alias("begun"))
    # At one time ends look first, then the level changes, then starts look.
    w = Window.partitionBy(*KEY).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(probes).withColumn("level", F.last("values", True).over(w)).withColumn("upto", F.sum("begun").over(w)).where("kind != 0")
    by_claim = seen.groupBy("id", *KEY, "kind").agg(F.max("level").alias("level"), F.max("upto").alias("most"), F.min("upto").alias("least"))
    start, end = F.when(F.col("kind") == 1, F.col("least")), F.when(F.col("kind") == -1, F.col("most"))
    hit = by_claim.groupBy("id").agg((F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("level"))), F.lit(0)) > 1).alias("_at_start"), (F.max(end) > F.min(start)).alias("_within"))
    out = claims.join(hit.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    status = (
        F.when(F.col("_at_start").isNull(), "unknown")
        .when(F.col("_at_start") | F.col("_within"), "conflicted")
        .when(F.col("until") <= as_of, "stale")
        .otherwise("source_supported")
    )
    return out.select("id", status.alias("status"))
