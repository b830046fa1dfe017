"""Connected components of links, and runs of equal keys in sorted batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, forget, stored

by_value(__name__)


def _round(edges: DataFrame) -> DataFrame:
    """c, p, changed: edges after one large-star and one small-star.

    Large-star moves an edge from its parent to the parent's own least parent. A parent of very many children is
    joined, not grouped, so a skewed join is split; roots match nothing and their edges stay. Small-star leaves a
    child its least parent and links the other parents to that one.
    """
    least = edges.groupBy(F.col("c").alias("x")).agg(F.min("p").alias("m"))
    jumped = edges.join(least, edges["p"] == least["x"], "left").select("c", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved"))
    w = Window.partitionBy("c").orderBy("p", "moved")
    each = jumped.select("c", "p", "moved", F.first("p").over(w).alias("m"), F.lag("p").over(w).alias("before")).where("before is null or before < p")
    first = F.col("before").isNull()
    return each.select(F.when(first, F.col("c")).otherwise(F.col("p")).alias("c"), F.col("m").alias("p"), (F.col("moved") | ~first).alias("changed"))


def forest(links: DataFrame) -> DataFrame:
    """id, component (the least id that id reaches), stored, for every end of links (a, b) that is not its own component; links are read twice, so they should be stored."""
    edges, changed = links.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c > p"), True
    before = None
    while changed:
        seen = Observation()
        after = _round(edges).observe(seen, F.sum(F.col("changed").cast("long")).alias("n")).drop("changed")
        edges = stored(after, "components")
        # No edge moved and no child had two parents: what is left are stars.
        changed = bool(seen.get["n"])
        if before is not None:
            forget(before)
        before = edges
    return edges.select(F.col("c").alias("id"), F.col("p").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """id, component: for every end of links (a, b) with a != b the least id that it reaches."""
    stars = forest(links)
    roots = stars.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.union(roots)


def runs(batches, keys: int):
    """(table, bounds) of sorted batches: rows bounds[k] to bounds[k + 1] have equal values in the first `keys` columns, and no run is cut."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        new = np.zeros(t.num_rows - 1, bool)
        for c in t.columns[:keys]:
            c = c.combine_chunks()
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], new)))
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks(), starts
        held = t.slice(cut)
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])
