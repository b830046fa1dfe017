"""A shared budget's ledger (additional: from the specification of later blocks).

Before a paid call its cost is reserved; afterwards the call is settled, given back, or its outcome stays uncertain. A
reservation without an outcome ends after hold_seconds. A scope's limit is one decision after another by nature, so
its events pass by in order of time; scopes are independent. What is kept of a scope is its sums, its open and
uncertain reservations, and for hold_seconds the names of ended ones, whatever it decided before.

On a stream, events wait until the watermark has passed them, and timers then decide them in the same order, so the
result doesn't depend on how events are cut into micro-batches.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("reserve", "settle", "release", "uncertain")
EVENTS = "scope string, call string, t long, kind string, amount long"
OUTPUT = f"{EVENTS}, verdict string, spent long, held long"
OPEN, UNSURE, ENDED = 0, 1, 2
US = 1_000_000


class Ledger:
    """A scope's sums and reservations: call -> [amount, when it ends, state]."""

    def __init__(self, spent: int = 0, held: int = 0, calls: dict | None = None):
        self.spent, self.held, self.calls = spent, held, calls or {}
        self.ends = [(end, call) for call, (_, end, state) in self.calls.items() if state != UNSURE]
        heapq.heapify(self.ends)

    def _until(self, t: int, hold: int) -> None:
        """Ends what has ended by t: open reservations are given back, names of ended ones are forgotten."""
        while self.ends and self.ends[0][0] <= t:
            end, call = heapq.heappop(self.ends)
            amount, own, state = self.calls.get(call, (0, None, None))
            if own != end or state == UNSURE:
                continue
            if state == OPEN:
                self.held -= amount
                self._end(call, amount, end + hold)
            else:
                del self.calls[call]

    def _end(self, call: str, amount: int, forget: int) -> None:
        self.calls[call] = [amount, forget, ENDED]
        heapq.heappush(self.ends, (forget, call))

    def decide(self, call: str, t: int, kind: str, amount: int | None, limit: int | None, hold: int) -> str:
        self._until(t, hold)
        known = self.calls.get(call)
        if kind == "reserve":
            if known:
                return "repeated"
            if limit is None:
                return "waiting"
            if amount is None or amount < 0:
                return "invalid"
            if self.spent + self.held + amount > limit:
                return "refused"
            self.held += amount
            self.calls[call] = [amount, t + hold, OPEN]
            heapq.heappush(self.ends, (t + hold, call))
            return "admitted"
        if kind not in KINDS:
            return "invalid"
        if not known or known[2] == ENDED:
            return "late"
        if kind == "uncertain":
            known[2] = UNSURE
            return "uncertain"
        if kind == "settle" and (amount is None or not 0 <= amount <= known[0]):
            # More than was reserved must be looked at; until then all of it stays held.
            known[2] = UNSURE
            return "overrun"
        self.held -= known[0]
        self.spent += amount if kind == "settle" else 0
        self._end(call, known[0], t + hold)
        return "settled" if kind == "settle" else "released"


def rank(kind: str | None) -> int:
    """Of events at one time outcomes go before reservations."""
    return 1 if kind == "reserve" else 0


def _order(r: tuple) -> tuple:
    """Events that are equal in all of these are equal."""
    call, t, kind, amount = r
    return t, rank(kind), call, kind or "", amount is None, amount or 0


def _together(reservations: DataFrame, outcomes: DataFrame, *more: str) -> DataFrame:
    asks = reservations.select("scope", "call", "t", F.lit("reserve").alias("kind"), F.col("amount").cast("long").alias("amount"), *more)
    ends = outcomes.select("scope", "call", "t", "kind", F.col("amount").cast("long").alias("amount"), *more)
    return asks.unionByName(ends.where("kind is null or kind <> 'reserve'")).where("call is not null and t is not null")


def budget(reservations: DataFrame, outcomes: DataFrame, limits: DataFrame, hold_seconds: int) -> DataFrame:
    """scope, call, t, kind, amount, verdict, spent and held (both after it) of every event, in order of t, outcomes first.

    reservations: scope, call, t (microseconds), amount; outcomes: the same and kind: settle, release or uncertain;
    limits: scope, limit, one row a scope. verdict of a reservation: admitted, refused, repeated (the call has a
    reservation or had one up to hold_seconds ago), invalid (no amount or a negative one) or waiting (the scope
    has no limit); of an outcome: settled, released, uncertain, overrun (more than reserved, or no amount: stays held),
    late (nothing is reserved: for reconciliation by hand, counted nowhere) or invalid (no such kind). spent + held
    never pass the limit. A null scope is a scope without a limit. Rows without call or t are left out; other columns too.

    A scope's events pass through one task, sorted, and only its ledger is held in memory.
    """
    hold = hold_seconds * US
    rows = _together(reservations, outcomes).join(limits.select("scope", F.col("limit").cast("long").alias("limit")), "scope", "left")
    rows = rows.withColumn("_rank", (F.coalesce("kind", F.lit("")) == "reserve").cast("int"))

    def folded(batches):
        own, ledger = None, None
        for b in batches:
            verdicts, spent, held = [], [], []
            for scope, call, t, kind, amount, limit in zip(*(b.column(c).to_pylist() for c in ("scope", "call", "t", "kind", "amount", "limit")), strict=True):
                if own != (scope,):
                    own, ledger = (scope,), Ledger()
                verdicts.append(ledger.decide(call, t, kind, amount, limit, hold))
                spent.append(ledger.spent)
                held.append(ledger.held)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("scope", "call", "t", "kind", "amount")), pa.array(verdicts, pa.string()), pa.array(spent, pa.int64()), pa.array(held, pa.int64())],
                names=["scope", "call", "t", "kind", "amount", "verdict", "spent", "held"],
            )

    ordered = rows.repartition("scope").sortWithinPartitions("scope", "t", "_rank", "call", F.coalesce("kind", F.lit("")), F.col("amount").asc_nulls_last())
    return ordered.mapInArrow(folded, OUTPUT)


class BudgetProcessor(StatefulProcessor):
    def __init__(self, limits: dict, hold_seconds: int):
        self.limits, self.hold = limits, hold_seconds * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "spent long, held long, timer long")
        self.calls = handle.getMapState("calls", "call string", "amount long, until long, state int")
        self.pending = handle.getListState("pending", "call string, t long, kind string, amount long")

    def _timer(self, spent: int, held: int, timer: int | None, wanted: int | None) -> None:
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.sums.update((spent, held, wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for got in rows:
            amounts = [None if pd.isna(a) else int(a) for a in got["amount"]]
            new = list(zip(got["call"], (int(t) for t in got["t"]), got["kind"], amounts, strict=True))
            self.pending.appendList(new)
            first = min([t for _, t, _, _ in new] + ([] if first is None else [first]))
        spent, held, timer = self.sums.get() if self.sums.exists() else (0, 0, None)
        # The first millisecond after the earliest event that waits.
        wanted = first // 1000 + 1
        self._timer(spent, held, timer, wanted if timer is None else min(timer, wanted))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        due = sorted((r for r in waiting if r[1] < passed), key=_order)
        rest = [r for r in waiting if r[1] >= passed]
        spent, held, _ = self.sums.get()
        ledger = Ledger(spent, held, {k[0]: list(v) for k, v in self.calls.iterator()})
        before = {c: tuple(v) for c, v in ledger.calls.items()}
        limit, out = self.limits.get(key[0]), []
        for call, t, kind, amount in due:
            out.append((key[0], call, t, kind, amount, ledger.decide(call, t, kind, amount, limit, self.hold), ledger.spent, ledger.held))
        for call in before.keys() - ledger.calls.keys():
            self.calls.removeKey((call,))
        for call, v in ledger.calls.items():
            if before.get(call) != tuple(v):
                self.calls.updateValue((call,), tuple(v))
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        # The timer that has expired is gone.
        self._timer(ledger.spent, ledger.held, None, min(t for _, t, _, _ in rest) // 1000 + 1 if rest else None)
        frame = pd.DataFrame(out, columns=["scope", "call", "t", "kind", "amount", "verdict", "spent", "held"])
        frame["amount"] = frame["amount"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def budget_stream(reservations: DataFrame, outcomes: DataFrame, limits: dict, hold_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """budget() on two streams of the same columns; limits: scope -> limit, a configuration.

    An event is decided once the watermark, `delay` behind the latest event of the slower stream, has passed it; events
    behind the watermark are dropped. Memory: a scope's events of `delay`, and its ledger.
    """
    timed = lambda df: df.where("call is not null and t is not null").withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)
    events = _together(timed(reservations), timed(outcomes), "at")
    return events.groupBy("scope").transformWithStateInPandas(BudgetProcessor(limits, hold_seconds), OUTPUT, "Append", "EventTime")
