"""Search, versions and recomputation against plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketspark.operators import recompute, search, versions

# --- vectors ----------------------------------------------------------------------------------------------------


def vector_rows(n=400, dim=8, seed=1):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centers)], rng.choice("abc")) for i in range(n)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, partner string")


def plain_nearest(rows, asks, k, filtered):
    import math

    ints = lambda v: [math.floor(x * search.STEPS + 0.5) for x in v]
    usable = [(i, ints(v), p) for i, v, p in rows if i is not None and v and None not in v]
    out = set()
    for q, v, p in [(i, ints(v), p) for i, v, p in asks if i is not None and v and None not in v]:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w, o in usable if i != q and len(w) == len(v) and (not filtered or p is None or o == p))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scored[:k])}
    return out


ODD_VECTORS = [(1000, None, "a"), (1001, [], "a"), (1002, [1.0, None], "b"), (1003, [1.0, 2.0], "b"), (1004, [1.0, 2.0], None), (None, [0.5] * 8, "a"), (1005, [0.0] * 8, None)]


@pytest.mark.parametrize("filtered", [False, True])
def test_nearest_equals_all_pairs(spark, monkeypatch, filtered):
    monkeypatch.setattr(search, "BLOCK", 50)
    rows = vector_rows(150) + ODD_VECTORS
    asks = [r for r in rows if r[0] is not None and r[0] % 5 == 0] + ODD_VECTORS[1:4]
    left = vector_frame(spark, asks)
    got = search.nearest(vector_frame(spark, rows), left if filtered else left.drop("partner"), 7).collect()
    assert {(r.question, r.id, r.score, r["rank"]) for r in got} == plain_nearest(rows, asks, 7, filtered)
    assert search.nearest(vector_frame(spark, []), left, 7).count() == 0


@pytest.mark.parametrize("filtered", [False, True])
def test_index_recall(spark, monkeypatch, filtered):
    """At least 0.9 of the exact answers, from fewer cells than there are, also where a question sees its partner's vectors only."""
    monkeypatch.setattr(search, "BLOCK", 64)
    rows = vector_rows(600)
    df = vector_frame(spark, rows)
    asks = df.where("id % 10 = 0")
    asks = asks if filtered else asks.drop("partner")
    centroids = search.Centroids(df, cells=24)
    index = search.indexed(df, centroids)
    probes, share = search.calibrated(df, index, centroids, asks, 5, 0.9)
    found = search.approximate(index, centroids, asks, 5, probes)
    assert probes < 24
    assert share >= 0.9
    assert search.recall(found, search.nearest(df, asks, 5)) >= 0.9
    if filtered:
        partner = {i: p for i, _, p in rows}
        assert all(partner[r.question] == partner[r.id] for r in found.collect())


# --- hybrid -----------------------------------------------------------------------------------------------------


def test_hybrid_takes_odd_documents(spark):
    """No text, no vector or no terms: the other lists answer; shared identifiers outrank."""
    docs = [(1, "alpha beta art12345 gamma"), (2, "other words with art12345"), (3, "alpha beta gamma delta"), (4, None), (5, ""), (6, "!!!"), (None, "alpha beta"), (7, "nothing in common 99")]
    index = search.postings(spark.createDataFrame(docs, "id long, text string"))
    assert {r.id for r in index.collect()} == {1, 2, 3, 7}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.9, 0.1]), (5, [1.0, 0.1])], "id long, v array<double>")
    asking = spark.createDataFrame([(1,), (4,), (5,)], "question long")
    got = defaultdict(list)
    for r in search.hybrid(index, vectors, asking, k=5).orderBy("question", "rank").collect():
        got[r.question].append(r.id)
    # 2: second by words, first by identifiers; 3: first by words, second by vectors; equal scores go by id. 5: first by vectors.
    assert got[1] == [2, 3, 5]
    assert 4 not in got and set(got[5]) == {1, 3}
    assert search.hybrid(index.limit(0), vectors.limit(0), asking, k=5).count() == 0


def test_sums_of_shared_terms_stay_in_their_tasks(spark, monkeypatch):
    """Lexical and exact answers are those of all pairs; but no more than the best of each question and shard leave a task, though every pair has a score."""
    for name, value in (("SHARDS", 3), ("ASKS", 40), ("HITS", 64)):
        monkeypatch.setattr(search, name, value, raising=False)
    rng = random.Random(5)
    words = [f"art{i:05d}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(100)] + ["common art00001"] * 60 + [f"common only{i:05d}" for i in range(40)]
    index = search.postings(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).localCheckpoint()
    known = search.weights(index).localCheckpoint()
    asking = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "question long")
    asked = search.question_terms(index, known, asking).localCheckpoint()
    held, sizes = search._ranked, []

    def ranked(scores, k):
        scores = scores.localCheckpoint()
        sizes.append((scores.count(), scores.groupBy("question").count().agg(F.max("count")).first()[0]))
        return held(scores, k)

    monkeypatch.setattr(search, "_ranked", ranked)
    lexical = search.lexical(index, known, asked, 5)
    exact = search.exact(index, known, asking, 5)
    wanted = asked.join(index, "term").where("id != question")
    n, terms = index.select("id", "n").distinct().agg(F.count("*"), F.sum("n")).first()
    wanted = wanted.withColumn("score", F.expr(f"w * (1000000000 * tf div (1000 * tf + 10 * (50 + 50 * n * {n} div {terms})))"))
    named = index.where(F.col("term").rlike(search.IDENTIFIER)).join(known.select("term"), "term")
    same = named.where("id % 2 = 0").select(F.col("id").alias("question"), "term").join(named.select("id", "term"), "term").where("id != question").withColumn("score", F.lit(1))
    for got, pairs in ((lexical, wanted), (exact, same)):
        of = defaultdict(list)
        for q, i, score in pairs.groupBy("question", "id").agg(F.sum("score").cast("long").alias("score")).where("score > 0").collect():
            of[q].append((-score, i))
        assert {(r.question, r["rank"], r.id, r.score) for r in got.collect()} == {(q, k, i, -s) for q, rows in of.items() for k, (s, i) in enumerate(sorted(rows)[:5], 1)}
    assert max(most for _, most in sizes) <= 3 * 6


def test_answers_that_leave_tasks_do_not_grow_with_their_number(spark, monkeypatch):
    """Though every document answers every question and lies in one of forty tasks, no more than nine times k answers of a question are ranked at a time, and they are the right ones, by words, identifiers and vectors; and so are those of many small blocks of questions."""
    for name, value in (("FIRST_WORDS", 200), ("FIRST_VECTORS", 60), ("ASKS", 120), ("POSTINGS", 300), ("NUMBERS", 400), ("HITS", 64), ("BLOCK", 6)):
        monkeypatch.setattr(search, name, value, raising=False)
    rng = random.Random(7)
    words = [f"art{i:05d}" for i in range(12)]
    docs = {i: rng.choices(words, k=rng.randint(1, 14)) for i in range(2000)}
    index = search.postings(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id long, text string").repartition(40)).localCheckpoint()
    known = search.weights(index).localCheckpoint()
    asking = spark.createDataFrame([(i,) for i in range(0, 2000, 20)], "question long")
    asked = search.question_terms(index, known, asking).localCheckpoint()
    vectors = [(i, v, None) for i, v, _ in vector_rows(2000, dim=4)]
    frame = vector_frame(spark, vectors).repartition(40).localCheckpoint()
    held, sizes = search._ranked, []

    def ranked(scores, k):
        scores = scores.localCheckpoint()
        sizes.append(scores.groupBy("question").count().agg(F.avg("count")).first()[0] or 0)
        return held(scores, k)

    monkeypatch.setattr(search, "_ranked", ranked)
    got = [search.lexical(index, known, asked, 5), search.exact(index, known, asking, 5), search.nearest(frame, frame.where("id % 20 = 0"), 5)]
    centroids = search.Centroids(frame, cells=6)
    got.append(search.approximate(search.indexed(frame, centroids), centroids, frame.where("id % 20 = 0"), 5, 6))
    assert max(sizes) <= 6 * 9
    total, weight, same = sum(map(len, docs.values())), defaultdict(int), defaultdict(int)
    for r in asked.collect():
        for i, t in docs.items():
            tf = t.count(r.term)
            weight[r.question, i] += r.w * (1_000_000_000 * tf // (1000 * tf + 10 * (50 + 50 * len(t) * len(docs) // total)))
    for q in range(0, 2000, 20):
        for i, t in docs.items():
            same[q, i] = len({*docs[q]} & {*t})
    for scores, found in zip((weight, same), got, strict=False):
        wanted = set()
        for q in range(0, 2000, 20):
            best = sorted((-scores[q, i], i) for i in docs if i != q and scores[q, i] > 0)[:5]
            wanted |= {(q, i, -s, n) for n, (s, i) in enumerate(best, 1)}
        assert {(r.question, r.id, r.score, r["rank"]) for r in found.collect()} == wanted
    wanted = plain_nearest(vectors, [r for r in vectors if r[0] % 20 == 0], 5, False)
    for found in got[2:]:  # all six cells are visited
        assert {(r.question, r.id, r.score, r["rank"]) for r in found.collect()} == wanted


def test_terms_of_a_document(spark):
    """Terms are cut as the expression says, at any ASCII sign and at no other; only A to Z are lower-cased; a document too large for a batch keeps its terms together."""
    text = "B\u00c4R b\u00c4r x_y\u00a01\u20002 caf\u00e9-CAF\u00c9 \U0001f600z\x7fZ"
    rows = [(1, text), (2, None), (3, " \t"), (None, "x"), (4, " ".join(f"w{i % 3000}" for i in range(9000)))]
    got = {r.id: r for r in search.documents(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert sorted(got) == [1, 4] and (got[1].n, got[4].n) == (8, 9000)
    assert dict(zip(got[1].term, got[1].tf, strict=True)) == {"b\u00c4r": 2, "x": 1, "y\u00a01\u20002": 1, "caf\u00e9": 1, "caf\u00c9": 1, "\U0001f600z": 1, "z": 1}
    assert set(got[4].tf) == {3} and len(got[4].term) == 3000


# --- versions ---------------------------------------------------------------------------------------------------


def test_readers_stay_with_their_version(spark, tmp_path):
    log = versions.VersionLog(spark, f"file://{tmp_path}")
    assert log.current() is None
    one = log.publish({"facts": spark.range(5)}, revision=10)
    pinned = log.read(one, "facts")
    two = log.publish({"facts": spark.range(100, 102)}, revision=20)
    assert (one, two, log.current()) == (1, 2, 2)
    assert {r.id for r in pinned.collect()} == set(range(5)) and {r.id for r in log.read(two, "facts").collect()} == {100, 101}
    assert log.statuses() == {1: "superseded", 2: "published"}
    with pytest.raises(versions.Blocked):
        log.publish({"facts": spark.range(1)}, revision=15)
    assert len(list((tmp_path / "snapshots").iterdir())) == 2  # the stale run leaves nothing
    log.revoke(two)
    log.revoke(two)
    assert log.current() is None and log.statuses() == {1: "superseded", 2: "revoked"}  # the older one doesn't come back
    with pytest.raises(ValueError):
        log.read(two, "facts")
    three = log.publish({"facts": spark.range(7)}, revision=30)
    assert log.current() == three and log.read(three, "facts").count() == 7


def test_of_two_runs_at_once_the_stale_one_is_blocked(spark, tmp_path, monkeypatch):
    """A newer run publishes between a run's look at the log and its entry."""
    log, other = (versions.VersionLog(spark, f"file://{tmp_path}") for _ in range(2))
    entries, looked = log.entries, []

    def between():
        got = entries()
        if not looked:
            looked.append(1)
            other.publish({"facts": spark.range(3)}, revision=9)
        return got

    monkeypatch.setattr(log, "entries", between)
    with pytest.raises(versions.Blocked):
        log.publish({"facts": spark.range(2)}, revision=8)
    assert other.statuses() == {1: "published"} and other.read(1, "facts").count() == 3
    looked.clear()
    monkeypatch.setattr(other, "publish", lambda *_, **__: versions.VersionLog(spark, f"file://{tmp_path}").publish({"facts": spark.range(4)}, 11))
    assert log.publish({"facts": spark.range(6)}, revision=12) == 3
    assert other.statuses() == {1: "superseded", 2: "superseded", 3: "published"}


def test_version_as_of(spark):
    rng = random.Random(2)
    day = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)
    pubs = [(s, v, rng.randrange(100), day(rng.randrange(2000)), day(rng.randrange(2500)) if rng.random() < 0.3 else None) for v, s in enumerate(rng.choice("ab") for _ in range(80))]
    pubs += [("a", 200, None, day(5), None), (None, 201, 500, day(5), None), ("a", 202, 500, None, None), ("c", 203, 1, day(100), None), ("c", 204, 2, day(100), None)]
    asked = [(i, rng.choice(["a", "b", "c", "d", None]), day(rng.randrange(2600)) if i % 40 else None) for i in range(400)]
    got = versions.version_as_of(spark.createDataFrame(asked, "n int, scope string, at timestamp"), spark.createDataFrame(pubs, "scope string, version int, revision int, at timestamp, revoked_at timestamp"), day(5000)).collect()
    taken = defaultdict(list)
    for s, v, r, at, revoked in sorted((p for p in pubs if None not in p[:4]), key=lambda p: (p[3], p[1])):
        if all(r > x[1] for x in taken[s]):
            taken[s].append((v, r, at, revoked))
    want = {}
    for n, s, at in asked:
        held = [x for x in taken.get(s, []) if at and x[2] <= at][-1:]
        want[n] = held[0][0] if held and (held[0][3] is None or at < held[0][3]) else None
    assert {r.n: r.version for r in got} == want and len(got) == len(asked)


# --- recomputation ----------------------------------------------------------------------------------------------


def test_recomputation_equals_the_full_one(spark):
    """Random graphs with cycles, self-loops, edges to unknown nodes and nulls; values also fall."""
    for seed in range(2):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(60)]
        pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(75)] + [("n1", "n1"), ("n2", "gone"), ("gone", "n3"), (None, "n4"), ("n5", None)]
        old = {n: rng.choice([None, rng.randrange(100)]) for n in nodes}
        changed = rng.sample(nodes, 4)
        new = old | {n: rng.choice([None, rng.randrange(100), 500]) for n in changed}
        edges, nodes_of = spark.createDataFrame(pairs, "src string, dst string"), lambda d: spark.createDataFrame(list(d.items()), "node string, value long")
        before = recompute.computed(nodes_of(old), edges)
        got = recompute.recomputed(before, nodes_of(new), edges, spark.createDataFrame([(c,) for c in changed], "node string")).collect()
        reach, front = set(changed), set(changed)
        while front:
            front = {b for a, b in pairs if a in front and b is not None} - reach
            reach |= front
        value = dict(new)
        again = True
        while again:
            again = False
            for a, b in pairs:
                if a in value and b in value and value[a] is not None and (value[b] is None or value[a] > value[b]):
                    value[b], again = value[a], True
        assert {r.node: r.value for r in got} == value
        assert {r.node for r in got if r.touched} == reach & set(nodes) and len(got) == len(nodes)
        assert {r.node: r.value for r in recompute.computed(nodes_of(new), edges).collect()} == value


def test_nothing_changed_touches_nothing(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    inputs = spark.createDataFrame([("a", 3), ("b", 1)], "node string, value long")
    before = recompute.computed(inputs, edges)
    got = recompute.recomputed(before, inputs, edges, spark.createDataFrame([], "node string")).collect()
    assert {(r.node, r.value, r.touched) for r in got} == {("a", 3, False), ("b", 3, False)}
    assert recompute.affected(edges.limit(0), inputs.where(F.col("node") == "a").select("node")).count() == 1


def test_rounds_read_and_write_only_what_they_need(spark, monkeypatch):
    """A chain that starts at many sources: edges of sources are read once, and a round writes the values that rose only. More rounds than tables that are kept apart."""
    monkeypatch.setattr(recompute, "PARTS", 4, raising=False)
    wide, deep = 200, 12
    pairs = [(f"s{i}", "c0") for i in range(wide)] * 2 + [(f"c{i}", f"c{i + 1}") for i in range(deep)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    inputs = spark.createDataFrame([(f"s{i}", i) for i in range(wide)] + [(f"c{i}", None) for i in range(deep + 1)], "node string, value long")
    held, rows = recompute.stored_table, defaultdict(list)

    def stored(df, name):
        out = held(df, name)
        rows[name].append(out.count())
        return out

    monkeypatch.setattr(recompute, "stored_table", stored)
    got = {r.node: r.value for r in recompute.computed(inputs, edges).collect()}
    assert got == {f"s{i}": i for i in range(wide)} | {f"c{i}": wide - 1 for i in range(deep + 1)}
    assert sum(n > wide for n in rows["values"]) <= 2 + (deep + 1) // 3  # the start, every few rounds, the end
    assert rows["links-again"] == [deep]


# --- claims -----------------------------------------------------------------------------------------------------


def test_claims_against_all_pairs(spark):
    """Nulls, open and empty intervals, equal bounds, repeated rows and one property with most of the claims."""
    from docketspark.operators import claims

    rng = random.Random(6)
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = []
    for i in range(500):
        a = rng.randrange(300)
        rows.append((i, rng.choice(["s", "s", "s", "t", None]), rng.choice(["p", "p", "q", None]), rng.choice([1, 1, 1, 1, 2, None]), rng.choice([a, a, a, None]), rng.choice([a + rng.randrange(4), a + 1, a + 2, None if rng.random() < 0.05 else a + 1, a - 1])))
    rows += rows[:20]
    got = claims.statuses(spark.createDataFrame([(*r[:4], at(r[4]), at(r[5])) for r in rows], "id int, subject string, property string, value int, since timestamp, until timestamp"), F.lit(at(200))).collect()
    lo, hi = lambda r: -1 if r[4] is None else r[4], lambda r: 10**9 if r[5] is None else r[5]
    valid = [r for r in rows if None not in r[1:4] and lo(r) < hi(r)]
    want = {}
    for r in rows:
        if r not in valid:
            want[r[0]] = "unknown"
        elif any(r[1:3] == o[1:3] and r[3] != o[3] and lo(r) < hi(o) and lo(o) < hi(r) for o in valid):
            want[r[0]] = "conflicted"
        else:
            want[r[0]] = "stale" if hi(r) <= 200 else "source_supported"
    assert {r.id: r.status for r in got} == want and len(got) == len(rows)
    assert set(want.values()) == {"unknown", "conflicted", "stale", "source_supported"}


def test_a_property_with_very_many_claims_stays_linear(spark):
    """All claims hold at once, so there are 10^10 pairs; rows made anywhere in the plan stay a few a claim."""
    from docketspark.operators import claims

    n = 100_000
    rows = spark.range(n).select("id", F.lit("s").alias("subject"), F.lit("p").alias("property"), (F.col("id") % 3).alias("value"), F.timestamp_seconds(F.col("id")).alias("since"), F.timestamp_seconds(F.col("id") + n).alias("until"))
    got = {r.status: r["n"] for r in claims.statuses(rows, F.lit(dt.datetime(2024, 1, 1))).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"conflicted": n}


# --- listing ----------------------------------------------------------------------------------------------------


def test_listing_stops_at_the_limit(spark, tmp_path):
    """Many shards of two partners with other files and folders among them: the first keys, whatever the limit."""
    import hashlib

    from docketspark.sources.objects import list_objects

    keys = []
    for i in range(300):
        digest = hashlib.sha256(str(i).encode()).hexdigest()
        key = f"bureau-{'0' * 8}-0000-0000-0000-{'0' * 12}/partner-{i % 2:08d}-0000-0000-0000-{'0' * 12}/{digest[:2]}/{digest}"
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"x" * (i % 7))
        keys.append((key, i % 7))
        if i % 10 == 0:
            (tmp_path / key).with_name("0note.txt").write_text("no object")
            (tmp_path / key).with_name("f" * 64).write_text("another shard's name") if digest[:2] != "ff" else None
    (tmp_path / ".staging" / "a" / "b").mkdir(parents=True)
    (tmp_path / ".staging" / "a" / "b" / ("0" * 64)).write_text("a draft")
    (tmp_path / "bureau-x").write_text("a file where a folder is expected")
    keys.sort()
    for limit in (0, 1, 7, 299, 300, 1000):
        got = [(r.key, r.length, r.truncated) for r in list_objects(spark, f"file://{tmp_path}", limit).collect()]
        assert got == [(k, n, min(limit, 300) >= limit) for k, n in keys[:limit]]
    assert list_objects(spark, f"file://{tmp_path}/none", 5).isEmpty()


# --- chunks -----------------------------------------------------------------------------------------------------


def test_cuts_cost_least():
    """Every way to cut short texts, and texts that have sentences longer than a chunk."""
    import numpy as np

    from docketspark.operators.chunks import cuts, off

    for seed in range(60):
        rng = random.Random(seed)
        k = rng.randrange(1, 12)
        n, like = np.array([rng.choice([0, 1, 3, 5, 9, 40]) for _ in range(k)]), np.array([0, *(rng.randrange(1000) for _ in range(k - 1)), 0])

        def cost(ends, n=n, like=like):
            return sum(int(like[a] + off(n[a:b].sum(), 8, 16)) for a, b in zip([0, *ends[:-1]], ends, strict=True))

        ways = [[*(i + 1 for i in range(k - 1) if m >> i & 1), k] for m in range(1 << (k - 1))]
        assert cost(cuts(n, like, 8, 16)) == min(map(cost, ways)), seed


def test_chunks_tile_every_text(spark):
    from docketspark.operators.chunks import chunked

    rng = random.Random(9)
    prose = lambda n: " ".join(("w%d" % rng.randrange(90)) + rng.choice(["", "", "", "", "", ".", "!\n", "? "]) for _ in range(n))
    texts = [None, "", " ", "\n\n", "one", "no end at all " * 700, "é\U0001f600. " * 900, prose(399), prose(5000), prose(60_000), ".", "a.b!c?" * 1000]
    rows = [(i, None if i % 3 else "s", t, "clash") for i, t in enumerate(texts)] + [(None, "s", "a row without an id.", "clash"), (8, "s", texts[8], "clash")]
    got = defaultdict(list)
    for r in chunked(spark.createDataFrame(rows, "doc_id long, source string, text string, chunk string")).collect():
        got[r.doc_id, r.source].append(r)
    for i, source, text, _ in rows:
        own = sorted(got.get((i, source), []), key=lambda r: (r.chunk, r.start))
        if not text:
            assert not own
            continue
        assert [r.chunk for r in own] == list(range(len(own))) and "".join(r.text for r in own) == text
        assert [r.start for r in own] == [0, *(r.end for r in own[:-1])] and own[-1].end == len(text)
        assert all(r.text == text[r.start : r.end] for r in own) and sum(r.n_words for r in own) == len(text.split())
        if len(text.split()) > 3000 and i != 11:
            assert all(400 <= r.n_words <= 800 for r in own)


# --- bucketed tables --------------------------------------------------------------------------------------------


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    from docketspark.sources.tables import BUCKETS, read_bucketed, update_bucketed, write_bucketed

    df = spark.range(2000).select((F.col("id") % 3).cast("int").alias("tenant"), "id", F.lit("new").alias("state"))
    write_bucketed(df, f"file://{tmp_path}", "jobs", "tenant", "id", 16)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.glob("jobs/*/*/*.parquet")}
    before = files()
    assert len(before) == 48 and BUCKETS == 64
    keys = df.where("id in (7, 100, 101)").select("tenant", "id")
    change = lambda d: d.withColumn("state", F.when(F.col("id").isin(7, 100, 101), "done").otherwise(F.col("state")))
    seen = []
    update_bucketed(spark, f"file://{tmp_path}", "jobs", "tenant", "id", keys, lambda d: (seen.append(d), change(d))[1], 16)
    after = files()
    kept = {p for p in before if after.get(p) == before[p]}
    assert len(kept) == 45 and len(after) == 48  # three buckets have new files, the others their old ones
    rows = {r.id: (r.tenant, r.state) for r in read_bucketed(spark, f"file://{tmp_path}", "jobs").collect()}
    assert rows == {i: (i % 3, "done" if i in (7, 100, 101) else "new") for i in range(2000)}
    for bad in (lambda d: d.where("id < 0"), lambda d: d.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError, match="buckets"):
            update_bucketed(spark, f"file://{tmp_path}", "jobs", "tenant", "id", keys, bad, 16)
    assert files() == after
    update_bucketed(spark, f"file://{tmp_path}", "jobs", "tenant", "id", keys.limit(0), change, 16)
    assert files() == after
