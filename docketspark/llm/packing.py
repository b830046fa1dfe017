"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Rows are dealt by hash to shards of about SHARD_SIZE units of size and rows, each packed by itself, largest pieces first. A
shard keeps its open bins by residual capacity. A bin carries a bitmap of the duplicate clusters in it and one
bitmap for each of the first, second, ... document of a source. For a piece the search starts at the least
residual that holds it and goes to the next larger one until a bin is found whose bitmaps don't conflict: the
tightest compatible bin. Bins of equal residual and bitmaps are alike, so each such kind is tried once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import SPACE, by_value, n_words, null_key, stored

by_value(__name__)

CAPACITY = 2048
PER_SOURCE = 2
SHARD_SIZE = 4_000_000


def best_fit(sizes, sources, clusters, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """The bin of each piece and where it starts in it; pieces in the order given. sources, clusters: bits, cluster 0: no twin here."""
    place, start = [], []
    residuals: list[int] = []  # sorted, of open bins
    open_: dict[int, dict[tuple, list[int]]] = {}  # residual -> bitmaps -> bins
    bins = 0
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at, found = bisect_left(residuals, size), None
        while at < len(residuals) and found is None:
            for kind in open_[residuals[at]]:
                if not kind[0] & cluster and not kind[per_source] & source:
                    found = (residuals[at], kind)
                    break
            at += 1
        if found is None:
            b, left, kind = bins, capacity, (0,) * (per_source + 1)
            bins += 1
        else:
            left, kind = found
            alike = open_[left][kind]
            b = alike.pop()
            if not alike:
                del open_[left][kind]
                if not open_[left]:
                    del open_[left]
                    residuals.pop(bisect_left(residuals, left))
        place.append(b)
        start.append(capacity - left)
        planes, carry = [kind[0] | cluster], source
        for plane in kind[1:]:
            planes.append(plane | carry)
            carry &= plane
        left -= size
        if left > 0:
            if left not in open_:
                open_[left] = {}
                insort(residuals, left)
            open_[left].setdefault(tuple(planes), []).append(b)
    return place, start


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_size: int = SHARD_SIZE, size: str | None = None, cluster: str | None = None) -> DataFrame:
    """doc_id, copy, piece, size, source, shard, bin, start, bin_id: a row for each piece of each row of docs.

    docs: doc_id, text, source. size and cluster may name columns to use (a null or negative size counts as 0); else
    size is the number of words and cluster the text with case and white space evened out. A bin holds at most one piece of a
    cluster and per_source pieces of a source; null sources are a source. A document larger than a bin is cut
    into full pieces, each alone in its bin, and a rest; full pieces meet no other. Rows of size 0 (null and
    empty texts) take no room and get no bin (null). Equal rows are told apart by copy, 0 upwards, and are of one
    cluster, so they never share a bin. An empty table gives an empty result; other columns don't matter.
    """
    even = F.lower(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE}+", " "))
    rows = docs.select(
        "doc_id",
        F.col("source"),
        (F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)) if size else n_words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.col(cluster) if cluster else F.trim(even)).alias("cluster"),
    )
    rows = rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "source", "size", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    rows = stored(rows, "packing")
    total = rows.agg(F.sum(F.col("size") + 1)).first()[0] or 0  # rows without words count too
    shards = max(1, -(-total // shard_size))
    full, rest = F.floor(F.col("size") / capacity).cast("long"), F.col("size") % capacity
    sizes = F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when((rest > 0) | (F.col("size") == 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    pieces = rows.select("doc_id", "copy", "source", "cluster", F.posexplode(sizes).alias("piece", "size"))
    pieces = pieces.withColumn("piece", F.col("piece").cast("long")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).cast("long"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sized = pdf["size"].to_numpy() > 0
        own = pdf[sized]
        source = pd.factorize(own["_pk_source"])[0]
        twin = own.groupby("cluster")["cluster"].transform("size").to_numpy() > 1
        cluster = pd.factorize(own["cluster"].where(twin))[0]
        place, start = best_fit(own["size"].tolist(), [1 << int(s) for s in source], [1 << int(c) if c >= 0 else 0 for c in cluster], capacity, per_source)
        pdf["bin"] = pd.Series(place, index=own.index, dtype="Int64").reindex(pdf.index)
        pdf["start"] = pd.Series(start, index=own.index, dtype="Int64").reindex(pdf.index)
        return pdf[["doc_id", "copy", "piece", "size", "source", "shard", "bin", "start"]]

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy long, piece long, size long, source string, shard long, bin long, start long"
    out = pieces.withColumn("_pk_source", null_key("source")).groupBy("shard").applyInPandas(packed, schema)
    return out.withColumn("bin_id", F.concat_ws("-", "shard", F.col("bin")).alias("bin_id")).withColumn("bin_id", F.when(F.col("bin").isNotNull(), F.col("bin_id")))
