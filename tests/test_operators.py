import datetime as dt
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketspark import schemas as S
from docketspark.operators import ingest, maintenance, reads, tenancy, throttle, transitions
from docketspark.sources import bodies, objects, tables
from docketspark.streaming import intake

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
B, P, Q = (f"00000000-0000-0000-0000-{i:012d}" for i in (1, 2, 3))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def noon():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def parts(spark, rows):
    return spark.createDataFrame([(*r[:6], P if len(r) == 6 else r[6]) for r in rows], "request_id string, seq int, part_name string, filename string, declared_type string, content binary, partner_id string").withColumns({"bureau_id": F.lit(B), "arrival": F.timestamp_seconds(F.col("seq"))})


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_receive(spark):
    pdf = b"%PDF-1.4 x"
    rows = [
        ("ok", 1, "file", "../a.pdf", "application/pdf", pdf), ("none", 1, "other", None, None, b"x"), ("two", 1, "file", "a", None, pdf), ("two", 2, "file", "b", None, pdf),
        ("lies", 1, "file", "a", "image/png", pdf), ("zip", 1, "file", "a", None, b"PK\x03\x04"), ("empty", 1, "file", "a", None, b""), ("large", 1, "file", "a", None, pdf + b"x" * 4096), ("chatty", 1, "file", "a", None, pdf), ("chatty", 2, "n", None, None, b"x" * 100),
    ]
    out = ingest.receive(parts(spark, rows), max_bytes=4096, other_bytes=99).select("request_id", "error_code", "filename").collect()
    assert {r[0]: r[1] for r in out} == {"ok": None, "none": "validation_failed", "two": "validation_failed", "lies": "unsupported_media_type", "zip": "unsupported_media_type", "empty": "validation_failed", "large": "payload_too_large", "chatty": "payload_too_large"}
    assert {r[0]: r[2] for r in out}["ok"] == "a.pdf"
    received = ingest.receive(parts(spark, rows), 4096, 99)
    assert [(r.request_id, bytes(r.content), r.size_bytes) for r in ingest.with_content(received.where("error_code is null"), parts(spark, rows)).collect()] == [("ok", pdf, len(pdf))]
    assert "content" not in received.columns


def test_dedup_across_partners_and_revisions(spark):
    a, b = b"%PDF-1 a", b"%PDF-1 b"
    rows = [("1", 1, "file", "a", None, a), ("2", 2, "file", "a", None, a), ("3", 3, "file", "a", None, a, Q), ("4", 4, "file", "a", None, b)]
    received = ingest.receive(parts(spark, rows))
    no_materials, no_jobs = empty(spark, S.MATERIALS), empty(spark, S.JOBS)
    outcomes, materials, jobs = ingest.ingest(received, no_materials, no_jobs)
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {"1": "created", "2": "duplicate", "3": "created", "4": "created"}
    assert materials.count() == 3 == jobs.count()
    assert [x.count() for x in ingest.job_gaps(materials, jobs)] == [0, 0]
    outcomes, more, new_jobs = ingest.ingest(received, materials, jobs)
    assert {r.outcome for r in outcomes.collect()} == {"duplicate"} and more.isEmpty() and new_jobs.isEmpty()
    assert [f.dataType for f in materials.select(*S.MATERIALS.names).schema] == [f.dataType for f in S.MATERIALS]


def test_tables_prune_to_a_tenant(spark, tmp_path):
    p = spark.createDataFrame([("1", B, "x", None, T0, T0), ("2", Q, "y", None, T0, T0)], S.PARTNERS)
    tables.write_table(p, str(tmp_path), "partners", "bureau_id")
    back = tables.read_table(spark, str(tmp_path), "partners", S.PARTNERS)
    assert sorted(map(str, back.select(*S.PARTNERS.names).collect())) == sorted(map(str, p.collect()))
    assert all(B in f for f in reads.list_partners(back, B).inputFiles()) or "PartitionFilters: [isnotnull(bureau_id" in reads.list_partners(back, B)._jdf.queryExecution().toString()


def test_first_uploads_and_ticks(spark, tmp_path):
    rows = [(B, P, "a", T0, 1), (B, P, "a", at(5), 2), (B, Q, "a", at(6), 3), (B, P, "b", at(7), 4)]
    schema = "bureau_id string, partner_id string, sha256 string, arrival timestamp, n int"
    spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("n").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = intake.first_uploads(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = intake.every(stream, lambda df, batch: seen.extend(r.n for r in df.collect()), 1).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 3, 4]


def test_failed_pass_is_tried_again_at_the_next_tick(spark, tmp_path):
    """As long as the table is away passes fail; the stream goes on and a later pass does the work."""
    done, path = [], str(tmp_path / "table")

    def job(tick):
        done.append(None)
        done[-1] = spark.read.parquet(path).count()

    q = intake.passes(spark, job, 1).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        limit = time.time() + 60
        while not done and time.time() < limit:
            time.sleep(0.2)
        spark.range(3).write.parquet(path)
        while 3 not in done and time.time() < limit:
            time.sleep(0.2)
        assert done[0] is None and 3 in done and q.isActive
    finally:
        q.stop()


def test_rows_that_fail_checks_are_not_written(spark, tmp_path):
    good = [("i", B, "a" * 64, "c" * 20, T0, T0, T0)]
    tables.write_table(spark.createDataFrame(good, S.SESSIONS), str(tmp_path), "sessions", "bureau_id")
    bad = spark.createDataFrame([*good, ("j", B, "A" * 64, "c" * 20, T0, T0, T0), ("k", B, "a" * 64, "c", T0, T0, T0)], S.SESSIONS)
    for write in (lambda: tables.write_table(bad, str(tmp_path), "sessions"), lambda: tables.write_bucketed(bad, str(tmp_path), "sessions", "bureau_id", "id")):
        with pytest.raises(tables.CheckFailed, match="2 rows"):
            write()
    assert [r.id for r in tables.read_table(spark, str(tmp_path), "sessions", S.SESSIONS).collect()] == ["i"]


def test_byte_limit(spark):
    df = spark.createDataFrame([("r", 1, 6), ("r", 2, 4), ("r", 3, 1), ("r", 4, 1)], "r string, seq int, n long")
    assert [x.over for x in ingest.first_over_limit(df, 10, ["r"], ["seq"], "n").orderBy("seq").collect()] == [False, False, True, False]


def test_tenancy(spark):
    p = spark.createDataFrame([("1", B, "x", None, T0, T0), ("2", Q, "y", None, T0, T0)], S.PARTNERS)
    assert [r.id for r in reads.list_partners(p, B).collect()] == ["1"]
    for nobody in (None, ""):
        assert tenancy.tenant_scope(p, nobody).isEmpty()
        assert tenancy.foreign_rows(p, nobody).count() == 2
    assert reads.partner_exists(p, B, "2").first().found is False
    assert reads.get_partner(p, B, "1").count() == 1


def job(i, status, attempts, expires, error=None, most=5):
    owner = None if expires is None else "w"
    return (str(i), B, P, str(i), "extract_document", status, "s", attempts, most, f"extract_document:{i}", T0, owner, expires, error, T0, T0)


def test_reclaim(spark):
    edge = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    rows = [job(1, "running", 1, at(0)), job(2, "running", 5, at(0)), job(3, "running", 1, edge), job(4, "running", 1, None), job(5, "queued", 1, at(0))]
    jobs = spark.createDataFrame(rows, S.JOBS)
    after, n = transitions.reclaim_expired_leases(jobs, B, noon())
    assert n.first().reclaimed == 2
    assert {r.id: r.status for r in after.collect()} == {"1": "queued", "2": "failed", "3": "running", "4": "running", "5": "queued"}
    assert transitions.reclaim_expired_leases(jobs, None, noon())[1].first().reclaimed == 0


def test_retry(spark):
    m = spark.createDataFrame([(str(i), B, P, "f", "application/pdf", 1, "0" * 64, "k", s, None, "boom", T0, T0) for i, s in enumerate(["failed", "partial", "completed", "failed"])], S.MATERIALS)
    j = spark.createDataFrame([job(0, "failed", 2, None, "boom"), job(1, "failed", 5, None, "boom"), job(2, "completed", 1, None)], S.JOBS)
    asked = m.select("bureau_id", "partner_id", F.col("id").alias("material_id"))
    m2, j2, refused = transitions.retry_materials(m, j, asked, noon())
    assert [r.id for r in refused.collect()] == ["2"]
    assert {r.id: (r.status, r.error) for r in m2.collect()} == {"0": ("queued", None), "1": ("queued", None), "2": ("completed", "boom"), "3": ("queued", None)}
    got = {r.material_id: (r.status, r.attempts, r.max_attempts, r.error) for r in j2.collect()}
    assert got == {"0": ("queued", 2, 5, None), "1": ("queued", 5, 6, None), "2": ("completed", 1, 5, None), "3": ("queued", 0, 5, None)}
    assert transitions.retry_materials(m2, j2, asked, noon())[2].count() == 4


def test_patch(spark):
    p = spark.createDataFrame([(str(i), B, f"n{i}", "old", T0, T0) for i in range(5)], S.PARTNERS)
    raw = ['{"name": " New "}', '{"note": null}', "{}", '{"note": "t", "who": 1}', '{"name": "x", "note": "  "}']
    patches = spark.createDataFrame([(str(i), B, r) for i, r in enumerate(raw)], "id string, bureau_id string, raw string")
    patches = patches.withColumn("b", bodies.patch_body(F.col("raw")))
    assert [r.id for r in patches.where("b is null").collect()] == ["3"]
    flat = patches.where("b is not null").select("id", "bureau_id", "b.name", "b.has_note", "b.note")
    after, bad = transitions.patch_partners(p, flat, noon())
    assert {r.id: (r.name, r.note) for r in after.collect()} == {"0": ("New", "old"), "1": ("n1", None), "2": ("n2", "old"), "3": ("n3", "old"), "4": ("x", None)}
    assert [(r.id, r.error_code) for r in bad.collect()] == [("2", "validation_failed")]


def test_list_response(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x")], "k string, n int, note string")
    assert bodies.list_response(df, ["k"]).first().body == '{"items":[{"n":1,"note":"x"},{"n":2,"note":null}]}'


def session_rows(spark, rows):
    return spark.createDataFrame([(str(i), B, f"{i:064x}", "c" * 20, T0, seen, expires) for i, (seen, expires) in enumerate(rows)], S.SESSIONS)


def test_session_edges(spark):
    now = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    s = dt.timedelta(seconds=1)
    idle = dt.timedelta(seconds=60)
    df = session_rows(spark, [(now - idle, now + s), (now - idle + s, now + s), (now, now), (now, now + s)])
    live, purged = transitions.purge_sessions(df, 60, noon())
    assert [r.id for r in live.orderBy("id").collect()] == ["1", "3"] and purged.first().purged == 2
    after, touched = transitions.touch_sessions(df, [f"{i:064x}" for i in range(3)], 60, noon())
    assert [r.session_id for r in touched.collect()] == ["1"]
    rest, removed = transitions.close_session(after, f"{3:064x}")
    assert rest.count() == 3 and removed.first().removed == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 90_000), st.integers(0, 90_000)), min_size=1, max_size=20))
def test_live_and_purged_are_complements(spark, rows):
    df = session_rows(spark, [(at(a), at(b)) for a, b in rows])
    live, purged = transitions.purge_sessions(df, 3600, noon())
    assert live.count() + purged.first().purged == len(rows)


def model(events, most, window, lockout):
    """The state machine, event by event."""
    state, out = {}, {}
    for key, i, t, kind in sorted(events, key=lambda e: (e[2], e[1])):
        if kind == "success":
            state.pop(key, None)
            out[i] = None
            continue
        n, w, lock = state.get(key, (0, t, None))
        if lock is not None and lock > t:
            out[i] = False
            continue
        if lock is not None or t - w > window:
            n, w = 0, t
        out[i] = n < most
        state[key] = (n + 1, w, None) if n < most else (n, w, t + lockout)
    return out


def fold(spark, events, most, window, lockout):
    df = spark.createDataFrame([(k, i, at(t), kind) for k, i, t, kind in events], "key string, id long, at timestamp, kind string")
    return throttle.throttle(df, most, window, lockout)


def test_throttle_sequences(spark):
    cases = [
        (3, [("a", t, "attempt") for t in (0, 0, 0, 0)] + [("b", 0, "attempt")], [True, True, True, False, True]),
        (2, [("a", 0, "attempt")] * 3 + [("a", 301, "attempt"), ("a", 301, "success"), ("a", 301, "attempt"), ("a", 301, "attempt")], [True, True, False, True, None, True, True]),
        (3, [("a", 0, "attempt")] * 2 + [("a", 1000, "attempt")] * 4, [True] * 5 + [False]),
        (1, [("a", 0, "attempt"), ("a", 900, "attempt"), ("a", 1200, "attempt")], [True, False, True]),  # the window's and the lock's very end
    ]
    for most, seq, want in cases:
        events = [(k, i, t, kind) for i, (k, t, kind) in enumerate(seq)]
        got = {r.id: r.admitted for r in fold(spark, events, most, 900, 300).collect()}
        assert [got[i] for i in range(len(seq))] == want
    wait = fold(spark, [("a", i, 0, "attempt") for i in range(2)], 1, 900, 300).where("not admitted").first()
    assert wait.retry_after_us == 300_000_000
    burst = fold(spark, [("a", i, 0, "attempt") for i in range(400)], 10, 900, 900)
    assert burst.where("admitted").count() == 10


def test_throttle_against_model_and_stream(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.choice("abc"), i, rng.randrange(0, 40_000), "success" if rng.random() < 0.1 else "attempt") for i in range(600)]
    want = model(events, 3, 900, 300)
    assert {r.id: r.admitted for r in fold(spark, events, 3, 900, 300).collect()} == want
    from docketspark.streaming.throttle import throttle_stream

    rows = sorted(((k, i, t * 1_000_000, kind) for k, i, t, kind in events), key=lambda r: (r[2], r[1]))
    schema = "key string, id long, t long, kind string"
    for n, part in enumerate((rows[:250], rows[250:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = throttle_stream(stream, 3, 900, 300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_throttle_splits_a_hot_key_and_keeps_null_keys(spark):
    rng = random.Random(6)
    events, t = [], 0
    for i in range(3000):
        t += rng.choice((0, 1, 200, 800, 950, 2000))
        events.append((rng.choice((None, "hot", "hot")), i, t, "success" if rng.random() < 0.05 else "attempt"))
    want = {}
    for key in (None, "hot"):
        want |= model([e for e in events if e[0] == key], 3, 900, 300)
    out = fold(spark, events, 3, 900, 300)
    assert {r.id: r.admitted for r in out.collect()} == want
    assert out.columns == ["key", "id", "at", "kind", "admitted", "retry_after_us"] and fold(spark, [("a", 0, 0, "attempt")], 3, 900, 300).count() == 1
    timed = spark.createDataFrame([("k", i, n) for i, n in enumerate([0, 5, 15, 16, 26, 37, 38])], "key string, id long, t long")
    assert [r.run for r in throttle._runs(timed, 10).orderBy("id").collect()] == [0, 0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("most,window,lockout", [(3, 900, 300), (1, 50, 2000), (0, 20, 30), (4, 0, 0), (2, 10**6, 1)])
def test_throttle_of_hot_keys_in_parallel(spark, most, window, lockout):
    """Pointer doubling gives what the plain loop gives: hot keys with and without pauses, ties, successes in a row and at either end, null keys, kinds and times, columns of clashing names."""
    rng = random.Random(most * 7 + window)
    events, t = [(k, -i, 0, "success") for k in ("hot", None) for i in range(1, 3)], 0
    for i in range(1200):
        t += rng.choice((0, 0, 1, 5, 30, 200, 1500 if i % 50 == 0 else 3))
        events.append((rng.choice((None, "hot", "hot", "cold")) if i > 60 else "hot", i, t, "success" if rng.random() < 0.06 else "attempt"))
    want = {}
    for key in (None, "hot", "cold"):
        want |= model([e for e in events if e[0] == key], most, window, lockout)
    df = spark.createDataFrame([(k, i, at(t), None if kind == "attempt" and i % 9 == 0 else kind, i) for k, i, t, kind in events] + [("hot", 10**6, None, "attempt", 0)], "key string, id long, at timestamp, kind string, t long")
    waits = {r.id: r.retry_after_us for r in throttle.throttle(df, most, window, lockout).collect()}
    out = throttle.throttle(df, most, window, lockout, at_once=350)
    got = out.collect()
    assert {r.id: r.admitted for r in got} == want and {r.id: r.retry_after_us for r in got} == waits and all(r.t == r.id for r in got)
    assert out.columns == ["key", "id", "at", "kind", "t", "admitted", "retry_after_us"]


def test_stream_state_is_gone_after_its_window(spark, tmp_path):
    from docketspark.streaming.throttle import throttle_stream

    schema, second = "key string, id long, t long, kind string", 1_000_000
    parts_ = [[("a", 0, 0), ("b", 1, 0), ("b", 2, second), ("b", 3, second)], [("c", 4, 1500 * second)], [("d", 5, 1600 * second)], [("a", 6, 1700 * second)]]
    for n, part in enumerate(parts_):
        spark.createDataFrame([(k, i, t + 10**12, "attempt") for k, i, t in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = throttle_stream(stream, 2, 900, 300, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "throttle").load(str(tmp_path / "state")).select("key.key").collect()
    assert {r.key for r in held} == {"a", "c", "d"}  # b's window and lock are over; a came again
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_replay_edges(spark):
    times = [0, 59, 118, 178, 200]  # a gap of exactly idle ends the session
    df = spark.createDataFrame([("k", i, at(t)) for i, t in enumerate(times)], "key string, id long, at timestamp")
    assert [r.live for r in throttle.replay_touches(df, 60, 10_000).orderBy("id").collect()] == [True, True, True, False, False]
    assert [r.live for r in throttle.replay_touches(df, 1000, 118).orderBy("id").collect()] == [True, True, False, False, False]


def test_store_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    bodies_ = [b"%PDF-1 one", b"%PDF-1 two"]
    df = spark.createDataFrame([(b,) for b in bodies_], "content binary").withColumn("sha256", F.sha2("content", 256))
    from docketspark.functions.scalars import object_key

    df = df.withColumn("key", object_key(F.lit(B), F.lit(P), F.col("sha256")))
    done = objects.publish(df, root).collect()
    assert {(r.size_bytes, r.action) for r in done} == {(10, "write")}
    (tmp_path / "objects" / "stray.txt").write_text("x")
    before = {p: p.stat().st_ino for p in (tmp_path / "objects").glob("bureau-*/**/*") if p.is_file()}
    again = objects.publish(df, root, objects.object_files(spark, root)).collect()
    assert {r.action for r in again} == {"already_present"} and all(p.stat().st_ino == n for p, n in before.items())
    with pytest.raises(Exception, match="key and content differ"):
        objects.publish(df.withColumn("content", F.lit(b"other")), root).collect()
    listing = objects.list_objects(spark, root, 10)
    assert [r.truncated for r in listing.collect()] == [False, False]
    one = objects.list_objects(spark, root, 1)
    assert [r.truncated for r in one.collect()] == [True]
    assert [r.truncated for r in objects.list_objects(spark, root, 2).collect()] == [True, True] and objects.list_objects(spark, root, 0).isEmpty()
    assert {bytes(r.content) for r in objects.read_objects(spark, root).where("path not like '%stray%'").collect()} == set(bodies_)
    known = df.limit(1).select(F.lit(B).alias("bureau_id"), F.lit(P).alias("partner_id"), "sha256")
    assert maintenance.orphans(listing, known, B).count() == 1
    assert maintenance.orphans(listing, known, Q).count() == 0
    plan = objects.plan_puts(df.select("key", F.lit(10).cast("long").alias("size_bytes")), one).groupBy("action").count()
    assert {r.action: r["count"] for r in plan.collect()} == {"already_present": 1, "write": 1}
    assert objects.sweep(objects.object_files(spark, root).where("path like '%stray%'")) == 1
    assert objects.object_files(spark, root).count() == 2


def test_staging_age(spark):
    df = spark.createDataFrame([("a", at(0), 7), ("b", at(12 * 3600 - 3600), 1), ("c", at(12 * 3600 - 3599), 1)], "path string, modified timestamp, length long")
    got = maintenance.staging_totals(maintenance.stale_staging(df, noon())).first()
    assert (got.removed, got.removed_bytes) == (2, 8)


def test_upsert_keeps_positions(spark):
    shown = spark.createDataFrame([("1", P, "old", 0), ("2", P, "old", 1)], "id string, partner_id string, v string, position int")
    new = spark.createDataFrame([("2", P, "new"), ("3", P, "new"), ("4", Q, "new")], "id string, partner_id string, v string")
    got = sorted((r.position, r.id, r.v) for r in transitions.upsert_list(shown, new, P).collect())
    assert got == [(-1, "3", "new"), (0, "1", "old"), (1, "2", "new")]


def test_provision(spark):
    df = spark.createDataFrame([("b1", "main", "Main", T0, T0)], S.BUREAUS)
    assert transitions.provision(df, "main", "x", noon()).first().id == "b1"
    fresh = transitions.provision(df, "other", "x", noon()).first().id
    assert fresh == transitions.provision(df, "other", "x", noon()).first().id != "b1"
