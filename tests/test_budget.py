"""The budget ledger against a plain loop, as a batch and as two streams."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketspark.streaming import budget as B

US = 1_000_000
HOLD = 100
FIELDS = "scope string, call string, t long, amount long"


def plain(events, limits, hold):
    """Every event again from a list of all reservations; sums are taken anew each time."""
    out, calls = {}, {}
    ordered = sorted(events, key=lambda e: (e[0] or "", e[2], e[3] == "reserve", e[1], e[3] or "", e[4] is None, e[4] or 0))
    for scope, call, t, kind, amount in ordered:
        own = calls.setdefault(scope, {})
        for c, r in list(own.items()):
            if r["state"] == "open" and r["end"] <= t:
                r.update(state="over", cost=0, gone=r["end"] + hold)
            if r["state"] == "over" and r["gone"] <= t:
                r["state"] = "forgotten"
        total = lambda: (sum(r["cost"] for r in own.values() if r["state"] in ("over", "forgotten")), sum(r["amount"] for r in own.values() if r["state"] in ("open", "unsure")))  # noqa: E731, B023
        r = own.get(call)
        live = r is not None and r["state"] != "forgotten"
        if kind == "reserve":
            limit = limits.get(scope)
            verdict = "repeated" if live else "waiting" if limit is None else "invalid" if amount is None or amount < 0 else "refused" if sum(total()) + amount > limit else "admitted"
            if verdict == "admitted":
                if r is not None:
                    own[(call, t)] = r
                own[call] = {"state": "open", "amount": amount, "end": t + hold}
        elif kind not in ("settle", "release", "uncertain"):
            verdict = "invalid"
        elif not live or r["state"] == "over":
            verdict = "late"
        elif kind == "uncertain":
            verdict, r["state"] = "uncertain", "unsure"
        elif kind == "settle" and (amount is None or amount < 0 or amount > r["amount"]):
            verdict, r["state"] = "overrun", "unsure"
        else:
            verdict = "settled" if kind == "settle" else "released"
            r.update(state="over", cost=amount if kind == "settle" else 0, gone=t + hold)
        out.setdefault((scope, call, t, kind, amount), []).append((verdict, *total()))
    return out


def drawn(seed, n=400):
    rng, events, t = random.Random(seed), [], 10**12
    for i in range(n):
        t += rng.choice((0, 1, 7, 30)) * US
        scope, call = rng.choice(("a", "a", "a", "b", "none", None)), f"c{rng.randrange(n // 3)}"
        kind = rng.choice(("reserve", "reserve", "settle", "release", "uncertain"))
        if rng.random() < 0.5 and events:
            scope, call = rng.choice(events[-6:])[:2]
        amount = rng.choice((0, 3, 5, 20, 60)) if rng.random() < 0.95 else rng.choice((None, -4))
        events.append((scope, call, t, kind, amount))
    return events + events[:9]


LIMITS = {"a": 400, "b": 60}


def frames(spark, events):
    asks = spark.createDataFrame([e[:3] + e[4:] for e in events if e[3] == "reserve"], FIELDS)
    ends = spark.createDataFrame([e[:3] + (e[4], e[3]) for e in events if e[3] != "reserve"], FIELDS + ", kind string")
    return asks, ends


def told(rows):
    out = {}
    for r in rows:
        out.setdefault((r.scope, r.call, r.t, r.kind, r.amount), []).append((r.verdict, r.spent, r.held))
    return {k: sorted(v) for k, v in out.items()}


def want(events):
    return {k: sorted(v) for k, v in plain(events, LIMITS, HOLD * US).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_plain_loop(spark, seed):
    events = drawn(seed) + [("a", "odd", 10**12, "guess", 1), ("a", "odd", 10**12, None, 1)]
    limits = spark.createDataFrame(list(LIMITS.items()) + [(None, 5)], "scope string, limit long")
    rows = B.budget(*frames(spark, events), limits, HOLD).collect()
    assert told(rows) == want(events)
    assert {r.verdict for r in rows} == {"admitted", "refused", "repeated", "waiting", "invalid", "settled", "released", "uncertain", "overrun", "late"}
    assert all(r.spent >= 0 and r.held >= 0 and r.spent + r.held <= LIMITS.get(r.scope, 0) for r in rows)
    assert B.budget(*frames(spark, []), limits, HOLD).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 30), st.sampled_from(B.KINDS), st.integers(0, 6)), max_size=40), st.integers(0, 12), st.integers(1, 9))
def test_ledger_never_passes_the_limit(events, limit, hold):
    ledger = B.Ledger()
    for call, t, kind, amount in sorted(events, key=lambda e: (e[1], B.rank(e[2]))):
        ledger.decide(call, t, kind, amount, limit, hold)
        assert 0 <= ledger.spent and 0 <= ledger.held and ledger.spent + ledger.held <= limit
        again = B.Ledger(ledger.spent, ledger.held, {c: list(v) for c, v in ledger.calls.items()})
        assert sorted(again.ends)[:1] == sorted(e for e in ledger.ends if ledger.calls.get(e[1], (0, None))[1] == e[0] and ledger.calls[e[1]][2] != B.UNSURE)[:1]


@pytest.mark.parametrize("seed", [3, 4])
def test_streams_equal_plain_loop_however_they_are_cut(spark, tmp_path, seed):
    """Two streams in shuffled micro-batches: an event may come up to the delay late."""
    rng, events = random.Random(seed), [e for e in drawn(seed, 200)]
    late = sorted(events, key=lambda e: e[2] + rng.randrange(0, 500 * US))
    schema, parts = FIELDS + ", kind string", 4
    # The last part pushes both watermarks beyond everything.
    cut = [late[i * len(late) // parts : (i + 1) * len(late) // parts] for i in range(parts)] + [[("end", "end", 2 * 10**12, "reserve", 0), ("end", "end", 2 * 10**12, "release", 0)]]
    for n, part in enumerate(cut):
        for name, keep in (("asks", True), ("ends", False)):
            rows = [e[:3] + (e[4], e[3]) for e in part if (e[3] == "reserve") == keep]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{n}"))
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    q = B.budget_stream(read("asks"), read("ends"), LIMITS, HOLD, "30 minutes").writeStream.format("parquet")
    q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).where("scope is null or scope <> 'end'").collect()
    assert told(rows) == want(events)
