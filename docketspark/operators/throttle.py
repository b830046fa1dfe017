"""Ordered per-key state machines: the login throttle and the replay of session use.

Neither clock-aligned nor session windows have the throttle's semantics: a window starts with the first attempt that
opens it, and a refused attempt changes state too. The events of a key of common size pass by one after another in a
task. A key with more is folded in parallel: a range search gives every attempt the attempt that would open the next
window if this one opened one, and following these links by pointer doubling tells which attempts do. All else follows
from the number of attempts since the window's opener. No step holds a key in one task.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.session import drop_stored, stored_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Attempts in the window, the window's start and the lock's end (microseconds).
NOTHING = (0, None, None)
#: Keys with more events are folded in parallel.
AT_ONCE = 200_000


def decide(state: tuple, t: int, success: bool, most: int, window: int, lockout: int) -> tuple[tuple, bool | None, int | None]:
    """(state after the event, admitted, time left); the latter null for a success or if admitted."""
    n, w, lock = state
    if success:
        return NOTHING, None, None
    if lock is not None and lock > t:
        return state, False, lock - t
    if w is None or lock is not None or t - w > window:
        n, w = 0, t
    if n >= most:
        return (n, w, t + lockout), False, lockout
    return (n + 1, w, None), True, None


def _runs(events: DataFrame, gap: int) -> DataFrame:
    """events (with key and t) with run and the first t of the key: a new run begins where the key had no event for more than gap. Both are null without a t.

    Within a block of gap there is no such pause, so the ends of blocks tell: they are few, and a hot key's events are
    reduced to them before they move.
    """
    block = F.floor(F.col("t") / gap)
    ends = events.where("t is not null").groupBy(F.col("key").alias("_k"), block.alias("_b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = Window.partitionBy("_k").orderBy("_b")
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(w) > gap, F.lit(False)).cast("long")
    runs = ends.withColumn("fresh", fresh).select("_k", "_b", F.sum("fresh").over(w).alias("run"), F.first("lo").over(w).alias("opened"))
    return events.withColumn("block", block).join(runs, F.col("key").eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b")), "left").drop("block", "_k", "_b")


def _folded(timed: DataFrame, said, most: int, window: int, lockout: int) -> DataFrame:
    """timed (events and _t) by key, one event after another."""
    names = [f.name for f in said.fields]

    def folded(batches):
        own, state = None, NOTHING
        for b in batches:
            admitted, wait = [], []
            for key, t, kind in zip(*(b.column(c).to_pylist() for c in ("key", "_t", "kind")), strict=True):
                if own != (key,):
                    own, state = (key,), NOTHING
                state, a, left = decide(state, t, kind == "success", most, window, lockout)
                admitted.append(a)
                wait.append(left)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(admitted, pa.bool_()), pa.array(wait, pa.int64())], names=names)

    return timed.repartition("key").sortWithinPartitions("key", "_t", "id").mapInArrow(folded, said)


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    """df with _pos, increasing in the order of by, and _part, the range that a row fell into; ranges hold about equally many rows, whatever their keys."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())
    return stored_table(ordered, "throttle-order").withColumn("_part", F.call_function("shiftright", F.col("_pos"), F.lit(33)))


def _scan(df: DataFrame, aggregate, value: Column, name: str, back: bool = False, own: bool = True) -> DataFrame:
    """df of _ordered() with name: the aggregate (sum, min, max) of value over the rows up to this one, or from it on (back), itself included or not (own).

    Each range is scanned alone, with the aggregate of the ranges before it, of which there is one row each.
    """
    order = F.col("_pos").desc() if back else F.col("_pos")
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    parts = df.groupBy(F.col("_part").alias("_p")).agg(aggregate(value).alias("_v"))
    before = Window.orderBy(F.col("_p").desc() if back else F.col("_p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_p", aggregate("_v").over(before).alias("_before"))
    both = F.array_compact(F.array(F.col("_in"), F.col("_before")))
    merged = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x) if aggregate is F.sum else (F.array_min if aggregate is F.min else F.array_max)(both)
    out = df.withColumn("_in", aggregate(value).over(within)).join(carried, F.col("_part") == F.col("_p"))
    return out.withColumn(name, merged).drop("_in", "_p", "_before")


def _doubled(events: DataFrame, most: int, window: int, lockout: int) -> DataFrame:
    """The events (in _row; with key, id, kind, _t and run) decided in parallel; every number below is a place among all attempts."""
    rows = _ordered(events, "key", "run", "_t", "id")
    # A window can't outlive a success or a run: what follows these opens one anyway.
    group, success = F.struct("key", "run"), F.col("kind") == "success"
    ends = rows.groupBy(F.col("_part").alias("_p")).agg(F.max_by(F.struct(group.alias("g"), success.alias("s")), "_pos").alias("_last"))
    ends = ends.select("_p", F.lag("_last").over(Window.orderBy("_p")).alias("_last"))
    last = F.coalesce(F.lag(F.struct(group.alias("g"), success.alias("s"))).over(Window.partitionBy("_part").orderBy("_pos")), F.col("_last"))
    rows = rows.join(ends, F.col("_part") == F.col("_p")).withColumn("_was", last).drop("_p", "_last")
    rows = rows.withColumn("_fresh", F.coalesce(F.col("_was.s") | ~F.col("_was.g").eqNullSafe(group), F.lit(True))).drop("_was")
    rows = _scan(rows, F.sum, (~success).cast("long"), "_g")
    # The first attempt at or after a fresh start, as seen from the rows before it and after it.
    first = F.when(F.col("_fresh"), F.when(success, F.col("_g") + 1).otherwise(F.col("_g")))
    rows = stored_table(_scan(_scan(rows, F.max, first, "_root"), F.min, first, "_end", back=True, own=False), "throttle-rows")

    tries = rows.where(~success).select("_g", "_t", "_root", "_end")
    at_lock = tries.select((F.col("_g") - most).alias("_g"), F.col("_t").alias("_lock"))
    locks = (F.col("_lock") <= F.col("_t") + window) & F.coalesce(F.col("_g") + most < F.col("_end"), F.lit(True))
    tries = tries.join(at_lock, "_g", "left").withColumn("_lock", F.when(locks, F.col("_lock")))
    tries = stored_table(tries.withColumn("_y", F.coalesce(F.col("_lock") + (lockout - 1), F.col("_t") + window)), "throttle-tries")

    asked = tries.select("_root", F.col("_y").alias("_t"), F.lit(1).alias("_asks"), "_g").unionByName(tries.select("_root", "_t", F.lit(0).alias("_asks"), "_g"))
    asked = _ordered(asked, "_root", "_t", "_asks", "_g")
    found = _scan(asked, F.max, F.when(F.col("_asks") == 0, F.col("_g")), "_found").where("_asks = 1").select("_g", "_found")
    after = F.when(F.col("_lock").isNotNull(), F.col("_g") + most + 1).otherwise(F.col("_g") + 1)
    links = tries.join(found, "_g").select("_g", F.greatest(F.coalesce(F.col("_found") + 1, after), after).alias("_to"), "_end")
    last = tries.agg(F.max("_g")).first()[0] or 0
    links = stored_table(links.where(F.coalesce(F.col("_to") < F.col("_end"), F.lit(True)) & (F.col("_to") <= last)).select("_g", "_to"), "throttle-links")
    drop_stored(asked)

    opened = stored_table(tries.where("_g = _root").select("_g"), "throttle-opened")
    while not links.isEmpty():
        reached = stored_table(opened.unionByName(opened.join(links, "_g").select(F.col("_to").alias("_g"))), "throttle-opened")
        twice = stored_table(links.join(links.select(F.col("_g").alias("_to"), F.col("_to").alias("_next")), "_to").select("_g", F.col("_next").alias("_to")), "throttle-links")
        drop_stored(opened)
        drop_stored(links)
        opened, links = reached, twice

    opener = opened.join(tries, "_g").select("_g", F.struct("_g", "_lock").alias("_opener"))
    out = _scan(rows.where(~success).select("_g", F.col("_g").alias("_pos"), "_part").join(opener, "_g", "left"), F.max, F.col("_opener"), "_own").select("_g", "_own")
    decided = rows.where(~success).join(out, "_g")
    nth, left = F.col("_g") - F.col("_own._g"), F.col("_own._lock") + lockout - F.col("_t")
    attempts = decided.select("_row.*", (nth < most).alias("admitted"), F.when(nth >= most, left).alias("retry_after_us"))
    rest = rows.where(success).select("_row.*", F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("long").alias("retry_after_us"))
    return attempts.unionByName(rest)


def throttle(events: DataFrame, most: int, window_seconds: int, lockout_seconds: int, at_once: int = AT_ONCE) -> DataFrame:
    """events with admitted and retry_after_us of every attempt, by key in order of (at, id).

    events: key, id, at (timestamp) and kind: attempt or success. A window begins with the attempt that finds none
    and ends when more than window_seconds have passed; attempt most + 1 within it locks the key for
    lockout_seconds, during which attempts are refused with the time left. At the lock's end, and after a
    success, everything starts afresh. Rows of success have a null admitted. A null key is a key; a null kind is
    an attempt; rows without a time have no place in the order and are left out. Other columns stay.

    at_once: keys with more events are folded in parallel, to the same result.
    """
    us = 1_000_000
    window, lockout = window_seconds * us, lockout_seconds * us
    said = events.select("*", F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("long").alias("retry_after_us")).schema
    timed = events.withColumn("_t", F.unix_micros(F.col("at").cast("timestamp"))).where("_t is not null")
    large = timed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("_k", F.lit(True).alias("_large"))
    if large.isEmpty():
        return _folded(timed, said, most, window, lockout)
    # At most one key for each at_once events.
    marked = timed.join(stored_table(large, "throttle-large"), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")
    hot = marked.where("_large").select("key", "id", F.coalesce("kind", F.lit("attempt")).alias("kind"), "_t", F.col("_t").alias("t"), F.struct(*events.columns).alias("_row"))
    hot = _runs(hot, max(window, lockout, 1))
    return _folded(marked.where("_large is null"), said, most, window, lockout).unionByName(_doubled(hot, most, window, lockout))


def replay_touches(events: DataFrame, idle_seconds: int, ttl_seconds: int) -> DataFrame:
    """events with live: whether the session that its key's first event opens was still live at each event, in order of (at, id).

    events: key, id, at. A touch within idle_seconds of the last live one and before ttl_seconds from the opening
    refreshes the session; a dead session stays dead. The first gap that is too long ends it, so the first run of events
    tells, and no key's events meet in one task. A null key is a key; without a time live is null.
    """
    us = 1_000_000
    timed = events.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.struct(*events.columns).alias("_row"))
    runs = _runs(timed, idle_seconds * us - 1)
    live = (F.col("run") == 0) & (F.col("t") - F.col("opened") < ttl_seconds * us)
    return runs.select("_row.*", live.alias("live"))
