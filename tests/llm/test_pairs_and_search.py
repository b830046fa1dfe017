"""Aligned tokenizers, simhash components and ranked search against plain loops."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
ODD = [None, "", " ", "\n", "a", "the same row", "the same row", "x  y   z ", " lead", "tail \n", "a\n \nb \n c", "it's 'tis DON'T they'll", "é ǘ ▁ x", "\u0000 nul", "<0x41> <s> </s> <|endoftext|>", "日本語 中文 ٣ ½", "\U0001f600" * 3 + " z", " no break 　", "a" * 3000]


def odd_documents(spark, texts=ODD):
    """Nulls, repeated rows, a null doc_id, columns with clashing names and very long texts."""
    long_ = " ".join(f"w{i % 700}\n" if i % 11 == 0 else f"w{i % 700}" for i in range(30_000))
    rows = [(i, t) for i, t in enumerate([*texts, long_])] + [(5, texts[5]), (None, "no id here at all"), (None, None)]
    extra = "block string, pair long, n int, best boolean, rank int, score double, item_id int, anchor int, fingerprint string, component_id string, shard int, term string"
    df = spark.createDataFrame([(*r, *([None] * 12)) for r in rows], f"doc_id long, text string, {extra}")
    return df, rows


# --- op12 -----------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """The contract by loops over tokens: dicts without doc_id."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from docketspark.llm.alignment import byte_alphabet

    raw = Path(P.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    a, b = Tokenizer.from_str(raw), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    names, byte = {i: t for t, i in json.loads(raw)["model"]["vocab"].items()}, byte_alphabet()

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    links, rows, count = [], [], Counter()
    for t in texts:
        ta = a.encode(" " + t, add_special_tokens=False).ids if t else []
        tb = b.encode(t) if t else []
        ba, bb = [bytes(byte[c] for c in names[i]) for i in ta], [of_b(i) for i in tb]
        if not t or b"".join(ba) != b" " + t.encode() or b"".join(bb) != b" " + t.encode():
            ta, tb, ba, bb = [], [], [], []
        spans = [[], []]
        for side, parts in zip(spans, (ba, bb), strict=True):
            at = 0
            for p in parts:
                side.append((at, at + len(p)))
                at += len(p)
        own, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(tb) and spans[1][j][0] < e:
                own.append((ta[i], tb[j]))
                j += 1
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        parts = [iter(zip(ids, side, strict=True)) for ids, side in zip((ta, tb), spans, strict=True)]
        for stop in shared:
            sides = []
            for tokens in parts:
                sides.append([])
                for i, (_, end) in tokens:
                    sides[-1].append(str(i))
                    if end == stop:
                        break
            groups.append("|".join(map(",".join, sides)))
        links.append(own)
        count.update(own)
        rows.append({"n_a": len(ta), "n_b": len(tb), "n_groups": len(groups), "n_links": len(own), "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""})
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    for r, own in zip(rows, links, strict=True):
        r["n_best"], r["count_sum"] = sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own)
    return rows


def check_alignment(spark, docs, monkeypatch):
    import public_tokenizers as P

    from docketspark.llm import alignment

    rows = docs.collect()
    want = Counter(json.dumps(w | {"doc_id": r.doc_id}, sort_keys=True) for r, w in zip(rows, plain_alignment([r.text for r in rows]), strict=True))
    out = alignment.align_tokenizers(docs, Path(P.path("byte_bpe_50k.json")).read_text(encoding="utf-8"), Path(P.path("piece_bpe_32k.model")).read_bytes())
    assert Counter(json.dumps(r.asDict(), sort_keys=True) for r in out.collect()) == want
    return out


def test_alignment_of_odd_texts(spark, monkeypatch):
    docs, _ = odd_documents(spark)
    out = check_alignment(spark, docs, monkeypatch)
    assert [f.simpleString() for f in out.schema][1:5] == ["n_a:bigint", "n_b:bigint", "n_groups:bigint", "n_links:bigint"]
    check_alignment(spark, docs.limit(0), monkeypatch)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_alignment_of_documents_in_many_blocks(spark, monkeypatch):
    from docketspark.llm import alignment

    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "PORTION", 3_000)
    check_alignment(spark, spark.read.parquet(str(SF / "documents.parquet")).repartition(3), monkeypatch)


def test_byte_tokenizer_on_every_code_point():
    """Texts cut at spaces and the whole tokenizer give the same ids around every code point."""
    import numpy as np
    import public_tokenizers as P
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    from docketspark.llm.alignment import ByteTokenizer, Encoder, PieceTokenizer

    raw = Path(P.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    whole = Tokenizer.from_str(raw)
    whole.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    encoder = Encoder(ByteTokenizer(raw), PieceTokenizer(Path(P.path("piece_bpe_32k.model")).read_bytes()))
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF and c != 0x2581]
    for at in range(0, len(points), 8192):
        texts = [f"a{c} b{c}{c} 1{c}? {c}\nz{c}" for c in points[at : at + 8192]]
        (a, n_a), (b, n_b) = encoder.encode(pa.array(texts))
        assert np.array_equal(a, [i for e in whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False) for i in e.ids])
        got = piece.encode(texts, num_threads=4)
        if not np.array_equal(n_b, [len(x) for x in got]):
            assert all(n == len(x) or n == 0 for n, x in zip(n_b, got, strict=True))
        assert np.array_equal(b, [i for x, n in zip(got, n_b, strict=True) if n for i in x])
        assert (n_a > 0).all()


# --- op11 -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance):
    """rows: (doc_id, fingerprint); the least doc_id reachable, by links between all pairs of fingerprints."""
    fps = sorted({f for _, f in rows})
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = defaultdict(list)
    for i, f in rows:
        if i is not None:
            ids[f].append(i)
    there = [i for i, f in enumerate(fps) if ids[f]]
    for n, i in enumerate(there):
        for j in there[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i in there:
        least[root(i)] = min([least.get(root(i), math.inf), *ids[fps[i]]])
    return {f: least.get(root(i)) if ids[f] else None for i, f in enumerate(fps)}


def check_simhash(rows, got, size, distance):
    fps = [(i, plain_fingerprint(t, size)) for i, t in rows]
    of = plain_components(fps, distance)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", of[f]) for i, f in fps)


def near_texts(n=60):
    """Texts of 300 words with few or many of them changed, so that fingerprints lie at all small distances."""
    rng = random.Random(5)
    out = []
    for _ in range(n // 10):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for k in range(10):
            text = base[:]
            for at in rng.sample(range(300), k):
                text[at] = f"x{rng.randrange(4000)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("k", [None, 7, 16])
def test_simhash_components(spark, monkeypatch, k):
    from docketspark.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 5)
    docs, rows = odd_documents(spark, ODD + near_texts())
    got = simhash.simhash_components(docs, 4, 4, k).collect()
    check_simhash(rows, got, 4, 4)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})
    assert simhash.simhash_components(docs.limit(0), 4, 4, k).count() == 0


def test_anchors_see_every_link():
    """Of two fingerprints at most four bits apart one visits the other's home, wherever the bits lie."""
    import numpy as np

    from docketspark.llm.simhash import anchors, bch

    rng = random.Random(3)
    assert [min(int(w).bit_count() for w in bch(k) if w) for k in (7, 10, 16, 18)] == [32, 28, 24, 22]
    x = [rng.getrandbits(64) for _ in range(300)] + [int(w) for w in bch(10)[:100]]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for v in x]
    seen = []
    for v in (x, y):
        i, j, home = anchors(np.array(v, np.uint64), 10, 4)
        assert home.sum() == len(v)
        seen.append((set(zip(i.tolist(), j.tolist(), strict=True)), dict(zip(i[home].tolist(), j[home].tolist(), strict=True))))
    assert all((n, seen[0][1][n]) in seen[1][0] or (n, seen[1][1][n]) in seen[0][0] for n in range(len(x)))


def test_joined_is_a_spanning_forest():
    import numpy as np

    from docketspark.llm.simhash import joined

    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    x = np.concatenate([x, x[:80] ^ np.uint64(5), x[:80] ^ np.uint64(0xF0), x[:40] ^ np.uint64(0xFF)])
    rng.shuffle(x)
    a, b = joined(x[:250], x[250:], 4)
    links = [(i, j) for i in range(250) for j in range(len(x)) if i != j and int(x[i] ^ x[j]).bit_count() <= 4]
    assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(links) | {(j, i) for i, j in links}

    def groups(edges):
        parent = list(range(len(x)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in edges:
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
        return [root(i) for i in range(len(x))]

    assert groups(links) == groups(zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) == len(x) - len(set(groups(links)))


# --- op13 -----------------------------------------------------------------------------------------------------


def plain_ranking(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    every = [(i, Counter(words(t))) for i, t in docs]
    every = [(i, c) for i, c in every if c]
    n_docs, n_terms = len(every), sum(sum(c.values()) for _, c in every)
    df = Counter(w for _, c in every for w in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, c in every:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in own if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("k", "shard", "pairs"), [(3, 400, 5), (50, 10**6, 10**6)])
def test_ranked_search(spark, monkeypatch, k, shard, pairs):
    from docketspark.llm import ranking

    monkeypatch.setattr(ranking, "SHARD_TERMS", shard)
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(ranking, "STRETCH", 8)
    rng = random.Random(4)
    docs, rows = odd_documents(spark, ODD + [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))) for _ in range(150)])
    asked = [(1, "aa B, ccc! a"), (2, "the SAME row"), (3, None), (4, ""), (5, "unknownword"), (None, "h hh"), (6, "x"), (6, "w3 w4"), (7, "日本語 \U0001f600\U0001f600\U0001f600 ½ it")]
    items = spark.createDataFrame([(*a, None, None) for a in asked], "item_id long, text string, term string, rank int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.ranked_search(docs, items, k).collect())
    want = plain_ranking(rows, asked, k)
    assert got == want
    assert ranking.ranked_search(docs.limit(0), items, k).count() == 0
    assert ranking.ranked_search(docs, items.limit(0), k).count() == 0


def test_blocks_cost_least(monkeypatch):
    """Against every way to cut short lists, and every posting in one block of a bound no smaller than its score."""
    import numpy as np

    from docketspark.llm import ranking

    monkeypatch.setattr(ranking, "STRETCH", 8)
    monkeypatch.setattr(ranking, "LONGEST", 5)
    monkeypatch.setattr(ranking, "PRICE", 9)
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 50, n) for n in (1, 2, 3, 7, 8, 8, 5)]
    upto = np.cumsum([len(x) for x in lists])
    docs = [np.sort(rng.choice(120, len(x), replace=False)) for x in lists]
    ends = ranking.block_ends(np.concatenate(docs), np.concatenate(lists), upto)
    for x, d, stop in zip(lists, docs, upto.tolist(), strict=True):
        n = len(x)
        own = [e - (stop - n) for e in ends.tolist() if stop - n < e <= stop]
        price = ranking.PRICE * x.mean()

        def cost(cuts, x=x, d=d, price=price):
            return sum((d[b - 1] - d[a] + 1) * x[a:b].max() + price for a, b in zip([0, *cuts[:-1]], cuts, strict=True))

        ways = [[*(i + 1 for i in range(n - 1) if m >> i & 1), n] for m in range(1 << (n - 1))]
        best = min(cost(w) for w in ways if max(b - a for a, b in zip([0, *w[:-1]], w, strict=True)) <= 5)
        assert own[-1] == n and abs(cost(own) - best) < 1e-6


def test_search_skips_blocks():
    """The k best are exact though most documents are never scored."""
    import numpy as np

    from docketspark.llm.ranking import Postings, search_shard

    rng = np.random.default_rng(7)
    n = 20_000
    docs = [np.sort(rng.choice(n, size, replace=False)) for size in (15_000, 4_000, 60)]
    scores = [rng.integers(1, 100, len(docs[0])), rng.integers(1, 1000, len(docs[1])), rng.integers(4000, 9000, len(docs[2]))]
    total = np.zeros(n, np.int64)
    for d, s in zip(docs, scores, strict=True):
        total[d] += s
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    (score, ids, _), looked = search_shard(Postings.of(docs, scores), np.arange(n), np.zeros(n, bool), 10, nothing)
    want = sorted(((-int(s), i) for i, s in enumerate(total) if s), key=lambda x: x)[:10]
    assert [(-int(s), int(i)) for s, i in zip(score, ids, strict=True)] == want
    assert looked < n / 4
