"""Mixing sources to target weights (native: DataFrame operations only).

Every source gets a token budget; inside it documents are taken in the order of a hash-random key until the
budget is spent exactly. The key's leading hex digits cut each source into key ranges of like size: a range is
one sort, the ranges' sums are prefix-summed per source, and both together give every document its distributed
prefix sum. A source that holds a third of all rows is so spread over thousands of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketspark.llm.common import SPACE, n_words, null_key, stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hex digits of the key that name a range: 16 ** RANGE_DIGITS ranges in each source.
RANGE_DIGITS = 3


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals: source, _mx_source, source_size, a row for each source. Adds target.

    Sources in code-point order (null last) weigh weights[0], weights[1], ... in turns and share the sum of all
    sizes. No target exceeds max_epochs times its source; the excess goes to the others by weight, again and
    again until none is above. In the order of cap over weight that fixed point is one running sum: a source is
    capped while its cap lies within its share of what is left. The windows see one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_mx_ratio", "_mx_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = totals.withColumn("_mx_weight", weight.cast("long")).withColumn("_mx_cap", F.col("source_size") * F.lit(max_epochs).cast("long"))
    df = df.withColumn("_mx_ratio", F.col("_mx_cap") / F.col("_mx_weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_mx_cap").over(fill), F.lit(0))
    left_weight = F.sum("_mx_weight").over(every) - F.coalesce(F.sum("_mx_weight").over(fill), F.lit(0))
    df = df.withColumn("_mx_level", left / left_weight)
    above = F.col("_mx_cap") <= F.col("_mx_level") * F.col("_mx_weight")
    level = F.max(F.when(~above, F.col("_mx_level"))).over(every)
    df = df.withColumn("_mx_flat", level)
    target = F.when(above, F.col("_mx_cap").cast("double")).otherwise(F.col("_mx_flat") * F.col("_mx_weight"))
    return df.withColumn("target", F.coalesce(target, F.lit(0.0)))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", range_digits: int = RANGE_DIGITS) -> DataFrame:
    """Adds size, source_size, target and taken to docs (doc_id, text, source and any more columns).

    size: words of the text, 0 for null and empty texts. taken: words of this row in the mix; a source's rows
    take floor(target) together: whole epochs first, then rows in key order, of which the last is cut. Null
    sources are a source of their own, after all others; rows without a doc_id are keyed by their text, rows with
    equal doc_id order by size, and equal rows count as so many rows. An empty table gives an empty result. Input columns named like a result are replaced.
    """
    sizes = docs.select(
        "source",
        null_key("source").alias("_mx_source"),
        F.substring(_key(seed), 1, range_digits).alias("_mx_range"),
        n_words(F.col("text")).alias("size"),
    )
    ranges = stored(sizes.groupBy("source", "_mx_source", "_mx_range").agg(F.sum("size").alias("_mx_range_size")), "mix-ranges")
    totals = ranges.groupBy("source", "_mx_source").agg(F.sum("_mx_range_size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs).select("_mx_source", "source_size", "target")
    earlier = Window.partitionBy("_mx_source").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        ranges.select("_mx_source", "_mx_range", F.coalesce(F.sum("_mx_range_size").over(earlier), F.lit(0)).alias("_mx_offset"))
        .join(targets, "_mx_source")
        .withColumn("_mx_words", F.floor("target").cast("long"))
        .withColumn("_mx_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_mx_words") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_mx_rest", F.col("_mx_words") - F.col("_mx_epochs") * F.col("source_size"))
    )
    keep = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}]
    rows = docs.select(*keep, n_words(F.col("text")).alias("size"), null_key("source").alias("_mx_source"), _key(seed).alias("_mx_key"))
    rows = rows.withColumn("_mx_range", F.substring("_mx_key", 1, range_digits)).join(plan, ["_mx_source", "_mx_range"])
    inside = Window.partitionBy("_mx_source", "_mx_range").orderBy("_mx_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_mx_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_mx_rest") - before))
    rows = rows.withColumn("_mx_part", part).withColumn("taken", F.col("_mx_epochs") * F.col("size") + F.col("_mx_part"))
    return rows.select(*keep, "size", "source_size", "target", "taken", "_mx_epochs", "_mx_part")


def _key(seed: str):
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(seed + ":"), own))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: every row as often as it is taken, whole texts first.

    The one row a source whose last take is cut short has the words taken, joined by single spaces. n_chars, if
    there, is the text's length again.
    """
    rows = mix_sources(docs, **options)
    words = F.split(F.regexp_replace(F.col("text"), f"^{SPACE}+", ""), f"{SPACE}+")
    whole = F.col("_mx_epochs") + (F.col("_mx_part") == F.col("size")).cast("long") * (F.col("_mx_part") > 0).cast("long")
    cut = (F.col("_mx_part") > 0) & (F.col("_mx_part") < F.col("size"))
    texts = F.concat(
        F.array_repeat(F.lit(False), whole.cast("int")),
        F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = rows.withColumn("_mx_cut", F.explode(texts))
    text = F.when(F.col("_mx_cut"), F.array_join(F.slice(words, 1, F.col("_mx_part").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)
