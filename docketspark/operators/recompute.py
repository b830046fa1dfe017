"""Recomputation of what depends on a change (additional: from the specification of later blocks).

A graph of dependencies has edges (src, dst): dst is derived from src. A node's value is the largest of its own input
and the values of all it is derived from, so cycles settle. Both walks are semi-naive: only what changed in one round
is joined with the edges in the next; each round is written to the shared folder, so no lineage grows. After the first
round only edges whose src is a dst, too, can carry anything, so the others are read once (`links`).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.session import drop_stored, stored_table

#: Tables of rounds that are kept apart before they are made one.
PARTS = 16


class Links(NamedTuple):
    """Stored edges (src, dst): all, and those whose src is some edge's dst."""

    all: DataFrame
    again: DataFrame


def links(edges: DataFrame | Links) -> Links:
    """Edges (src, dst) for several walks; repeated ones do no harm, those with a null are left out."""
    if isinstance(edges, Links):
        return edges
    every = stored_table(edges.select("src", "dst").where("src is not null and dst is not null"), "links")
    return Links(every, stored_table(every.join(every.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "links-again"))


def affected(edges: DataFrame | Links, changed: DataFrame) -> DataFrame:
    """node: the changed nodes (node) and all that depend on them, over edges (src, dst); cycles end. Stored."""
    every, again = links(edges)
    found = stored_table(changed.select("node").where("node is not null").distinct(), "affected")
    front = found
    while True:
        step = front.join(every if front is found else again, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = stored_table(step.join(found, "node", "left_anti"), "affected-front")
        if new.isEmpty():
            drop_stored(new)
            return found
        more = stored_table(found.unionByName(new), "affected")
        drop_stored(found)
        if front is not found:
            drop_stored(front)
        found, front = more, new


def _largest(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("value").alias("value"))


def settled(start: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """node, value: the least values at or above start's (node, value) at which no edge carries a larger one to its dst. Nodes without a start have null, and values reach them too. Stored.

    A round writes the values that rose and leaves the others where they are: a node's value is the largest of all its
    rows. What is sent is stored first, so that few values look for their nodes without moving all.
    """
    links_ = links(edges)
    parts = [stored_table(start.groupBy("node").agg(F.max("value").alias("value")), "values")]
    front, carrying = parts[0].where("value is not null"), links_.all
    while True:
        sent = stored_table(front.join(carrying, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("value").alias("_sent")), "values-sent")
        there = reduce(DataFrame.unionByName, parts).join(sent, "node").groupBy("node").agg(F.max("value").alias("value"), F.max("_sent").alias("_sent"))
        new = stored_table(there.where("value is null or _sent > value").select("node", F.col("_sent").alias("value")), "values")
        drop_stored(sent)
        if new.isEmpty():
            drop_stored(new)
            break
        if len(parts) == PARTS:
            one = stored_table(_largest(parts), "values")
            for part in parts:
                drop_stored(part)
            parts = [one]
        parts.append(new)
        front, carrying = new, links_.again
    out = stored_table(_largest(parts), "values") if len(parts) > 1 else parts[0]
    for part in parts:
        if part is not out:
            drop_stored(part)
    return out


def computed(inputs: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """node, value of all nodes: the full computation. inputs: (node, value), a row for every node, value null without an input of its own. Edges to or from other nodes don't count, as values are sent by nodes to nodes only."""
    return settled(inputs.where("node is not null").select("node", "value"), edges)


def recomputed(before: DataFrame, inputs: DataFrame, edges: DataFrame | Links, changed: DataFrame) -> DataFrame:
    """node, value, touched of all nodes after the inputs of the changed nodes (node) took new values, which `inputs` has; equal to computed(inputs, edges).

    before: node and value as computed with the old inputs. Only affected nodes start anew: from their own input and what
    unaffected nodes, whose values hold, send them; then values settle along edges among the affected. touched tells
    the affected, of which alone any value is read or written.
    """
    edges = links(edges)
    near = affected(edges, changed)
    touched = stored_table(near.join(inputs.select("node").distinct(), "node", "left_semi"), "touched")
    drop_stored(near)
    into = edges.all.join(touched.withColumnRenamed("node", "dst"), "dst", "left_semi")
    into = stored_table(into.join(touched.select(F.col("node").alias("src"), F.lit(True).alias("inside")), "src", "left").select("src", "dst", "inside"), "links-into")
    inside = into.where("inside").select("src", "dst")
    sent = into.where("inside is null").join(before.select(F.col("node").alias("src"), "value"), "src").select(F.col("dst").alias("node"), "value")
    own = inputs.join(touched, "node", "left_semi").select("node", "value")
    fresh = settled(own.unionByName(sent), Links(inside, inside))
    drop_stored(into)
    held = before.join(touched, "node", "left_anti").select("node", "value", F.lit(False).alias("touched"))
    return held.unionByName(fresh.select("node", "value", F.lit(True).alias("touched")))
