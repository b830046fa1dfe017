"""Ranked lexical search over inverted shards with variable blocks and block-max skipping.

Index: every task turns its documents into shards of about SHARD_TERMS terms, without a shuffle: a row for each term of
a shard with its postings (document numbers and frequencies, ascending), and one row with the shard's document ids
and lengths. The index holds all terms of all documents.

Search: asked terms get their weights from the whole index. A query block is a bounded number of (item, term) pairs.
For each shard the postings of asked terms are scored, and dynamic programming cuts each list into blocks so that
what their largest scores overstate the documents by, plus a fixed price a block, is least. The ends of all blocks
of an item's terms cut a shard into ranges; the sum of the largest scores of the blocks over it bounds a range. Ranges are scored
from the highest bound down, and all below the item's k-th best score so far are skipped: the result is exact.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, stored

by_value(__name__)

SHARD_TERMS = 2_000_000
#: (item, term) pairs that are searched at a time, about: what the driver and each task hold of the questions.
BLOCK_PAIRS = 200_000
#: Block boundaries are chosen among all of at most LONGEST postings within stretches of STRETCH.
STRETCH, LONGEST = 512, 64
#: A block costs as much as an overstatement of so many times the list's mean score, in documents.
PRICE = 32
K1_TIMES, M_TIMES = 1000, 20

#: ASCII letters lower-cased, digits and bytes from 0x80 as they are, all else a space.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


# --- index ----------------------------------------------------------------------------------------------------

INDEX = "shard string, term binary, df int, docs binary, tfs binary, ids array<bigint>"


def shard_rows(ids: list, lengths: list[int], words: list[pa.Array]) -> pa.RecordBatch:
    coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), lengths)
    key = (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | doc
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    tf, term, docs = np.diff(np.append(new, len(key))).astype("<u4"), key[new] >> 32, (key[new] & 0xFFFFFFFF).astype("<u4")
    n = np.bincount(term, minlength=len(coded.dictionary))
    cut = np.append(0, np.cumsum(n)).astype(np.int64)
    blob = lambda x: pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * cut), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    head = [pa.array([None], pa.binary()), pa.array([None], pa.int32()), pa.array([b""]), pa.array([np.array(lengths, "<u4").tobytes()]), pa.array([ids], pa.list_(pa.int64()))]
    rest = [coded.dictionary, pa.array(n, pa.int32()), blob(docs), blob(tf), pa.nulls(len(n), pa.list_(pa.int64()))]
    columns = [pa.concat_arrays([a, b]) for a, b in zip(head, rest, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex] * (len(n) + 1)), *columns], names=["shard", "term", "df", "docs", "tfs", "ids"])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), stored: INDEX, where the row without a term has the shard's ids and, as tfs, lengths of its documents. Texts without a term are not in it."""

    def built(batches):
        ids, lengths, words, size = [], [], [], 0
        for b in batches:
            batch = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = terms(text)
                if own:
                    ids.append(i)
                    lengths.append(len(own))
                    batch += own
                    size += len(own)
                if size >= SHARD_TERMS or len(batch) >= 200_000:
                    words.append(pa.array(batch, pa.binary()))
                    batch = []
                    if size >= SHARD_TERMS:
                        yield shard_rows(ids, lengths, words)
                        ids, lengths, words, size = [], [], [], 0
            if batch:
                words.append(pa.array(batch, pa.binary()))
        if ids:
            yield shard_rows(ids, lengths, words)

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(built, INDEX), "ranking-index")


# --- search in a shard ----------------------------------------------------------------------------------------


def _least_cost_ends(docs: np.ndarray, padded: np.ndarray, length: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Marks the block ends (1 to length) of each row of documents and scores, all rows at once: cost[j] is the least of cost[i] + (docs[j - 1] - docs[i] + 1) * max(scores[i:j]) + price."""
    rows, width = padded.shape
    cost, before = np.zeros((rows, width + 1)), np.zeros((rows, width + 1), np.int64)
    for j in range(1, width + 1):
        low = max(0, j - LONGEST)
        # Largest score of each padded[:, i:j]: running maxima from the right.
        top = np.maximum.accumulate(padded[:, low:j][:, ::-1], axis=1)[:, ::-1]
        total = cost[:, low:j] + top * (docs[:, j - 1, None] - docs[:, low:j] + 1) + price[:, None]
        best = total.argmin(1)
        cost[:, j], before[:, j] = total[np.arange(rows), best], best + low
    ends, at, there = np.zeros((rows, width + 1), bool), length.copy(), np.arange(rows)
    while len(there):
        ends[there, at] = True
        at = before[there, at]
        there, at = there[at > 0], at[at > 0]
    return ends


def block_ends(docs: np.ndarray, scores: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Ends (exclusive, in all postings) of the blocks of lists that end at upto, of at most LONGEST entries, so that what their largest scores overstate, added up over all documents from each block's first to its last, plus the price of the blocks, is least. Exact within stretches of STRETCH entries, at whose ends blocks end, too."""
    n = np.diff(upto, prepend=0)
    price = PRICE * np.diff(np.append(0, np.cumsum(scores.astype(np.float64)))[upto], prepend=0) / np.maximum(n, 1)
    own = np.repeat(np.arange(len(n)), -(-n // STRETCH))
    first = np.searchsorted(own, own)
    start = (upto - n)[own] + (np.arange(len(own)) - first) * STRETCH
    length = np.minimum(STRETCH, upto[own] - start)
    out, width, least = [], 1, 0
    while least < STRETCH:
        some = np.flatnonzero((length > least) & (length <= width))
        for at in range(0, len(some), 4096):
            rows = some[at : at + 4096]
            place = start[rows, None] + np.arange(width)
            place = np.minimum(place, len(scores) - 1)
            padded = np.where(np.arange(width) < length[rows, None], scores[place], 0)
            i, j = np.nonzero(_least_cost_ends(docs[place], padded, length[rows], price[own[rows]]))
            out.append(start[rows][i] + j)
        width, least = min(2 * width, STRETCH), width
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


class Postings:
    """A term's documents, scores and blocks in a shard: the first and last document and the largest score of each."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, ends: np.ndarray):
        starts = np.append(0, ends[:-1])
        self.docs, self.scores, self.first, self.last = docs, scores, docs[starts], docs[ends - 1]
        self.most = np.maximum.reduceat(scores, starts)

    @classmethod
    def of(cls, docs: list[np.ndarray], scores: list[np.ndarray]) -> list[Postings]:
        if not docs:
            return []
        upto = np.cumsum([len(d) for d in docs])
        ends = block_ends(np.concatenate(docs), np.concatenate(scores), upto)
        cut, at = np.searchsorted(ends, upto, "right"), np.append(0, upto)
        return [cls(d, s, ends[a:b] - x) for d, s, a, b, x in zip(docs, scores, np.append(0, cut), cut, at, strict=False)]


def search_shard(lists: list[Postings], ids: np.ndarray, null: np.ndarray, k: int, heap: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], int]:
    """(the k best of (scores, ids, null) in heap and of the shard, documents scored)."""
    stops = np.unique(np.concatenate([x for p in lists for x in (p.last, p.first - 1)]))
    bound = np.zeros(len(stops), np.int64)
    for p in lists:
        at = np.searchsorted(p.last, stops)
        there = at < len(p.last)
        there[there] = p.first[at[there]] <= stops[there]
        bound[there] += p.most[at[there]]
    order, done, looked = np.argsort(-bound, kind="stable"), 0, 0
    starts, step = np.append(-2, stops[:-1]), 16
    while done < len(order):
        least = heap[0][-1] if len(heap[0]) == k else 1
        some = order[done : done + step]
        some = np.sort(some[bound[some] >= max(least, 1)])
        if not len(some):
            break
        done, step = done + step, 4 * step
        docs, scores = [], []
        for p in lists:
            a, b = np.searchsorted(p.docs, starts[some], "right"), np.searchsorted(p.docs, stops[some], "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            docs.append(p.docs[at])
            scores.append(p.scores[at])
        doc, inverse = np.unique(np.concatenate(docs), return_inverse=True)
        total = np.zeros(len(doc), np.int64)
        np.add.at(total, inverse, np.concatenate(scores))
        looked += len(doc)
        good = total >= least
        parts = (total[good], ids[doc[good]], null[doc[good]])
        every = [np.concatenate(x) for x in zip(heap, parts, strict=True)]
        best = np.lexsort((every[1], every[2], -every[0]))[:k]
        heap = tuple(x[best] for x in every)
    return heap, looked


# --- search ---------------------------------------------------------------------------------------------------


def asked(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""

    def split(batches):
        for b in batches:
            pairs = [(i, w) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True) for w in set(terms(t))]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k, kind in enumerate((pa.int64(), pa.binary()))], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, "item_id long, term binary").distinct()


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def summed(batches):
        for b in batches:
            lengths = [np.frombuffer(x, "<u4") for x in b.column("tfs").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in lengths], pa.int64())], names=["d", "n"])

    got = index.where("term is null").select("tfs").mapInArrow(summed, "d long, n long").agg(F.sum("d"), F.sum("n")).first()
    return got[0] or 0, got[1] or 0


def search_block(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: each item's k best of every task, for a block of (item_id, term) pairs that the driver may hold."""
    words = F.broadcast(pairs.select("term").distinct())  # BLOCK_PAIRS at most, about
    df = {bytes(r.term): r.df for r in index.join(words, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    items = defaultdict(list)
    for r in pairs.collect():
        items[r.item_id].append(bytes(r.term))

    def found(batches):
        heaps = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for i in items}

        def search(rows: list[dict]) -> None:
            head = next(r for r in rows if r["term"] is None)
            ids = np.array([i or 0 for i in head["ids"]], np.int64)
            null = np.array([i is None for i in head["ids"]], bool)
            m = M_TIMES * (50 + 50 * np.frombuffer(head["tfs"], "<u4").astype(np.int64) * n_docs // n_terms)
            words, docs, scores = [], [], []
            for r in rows:
                if r["term"] is not None and weight[r["term"]]:
                    doc, tf = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("docs", "tfs"))
                    words.append(r["term"])
                    docs.append(doc)
                    scores.append(weight[r["term"]] * (1_000_000_000 * tf // (K1_TIMES * tf + m[doc])))
            lists = dict(zip(words, Postings.of(docs, scores), strict=True))
            for i, wanted in items.items():
                own = [lists[w] for w in wanted if w in lists]
                if own:
                    heaps[i], _ = search_shard(own, ids, null, k, heaps[i])

        rows = []
        for b in batches:
            for r in b.to_pylist():
                if rows and rows[-1]["shard"] != r["shard"]:
                    search(rows)
                    rows = []
                rows.append(r)
        if rows:
            search(rows)
        for i, (score, ids, null) in heaps.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int64()), pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    there = index.join(words, "term", "left_semi").unionByName(index.where("term is null"))
    dealt = there.repartition("shard").sortWithinPartitions("shard").select("shard", "term", "docs", "tfs", "ids")
    return dealt.mapInArrow(found, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k best rows of docs (doc_id, text) with a score above 0.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and all characters from U+0080 on. With N documents that
    have a term, L terms of theirs in all, n of one, df of a term and tf of it in the document, a term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), m is 50 + 50 n N div L, and the score is the sum over the item's terms,
    once each, of weight * (10^9 tf div (1000 tf + 20 m)). Equal scores rank by ascending doc_id, null last. Null and
    empty texts have no terms: they are no documents, and items without a known term have no rows. Repeated rows of docs
    are documents each; rows of one item_id are one item with the terms of all, and so are those without an item_id.
    Empty tables give an empty result; other columns don't matter.
    """
    index = build_index(docs)
    n_docs, n_terms = totals(index)
    pairs = stored(asked(items), "ranking-asked")
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [stored(search_block(index, pairs.where(block == b), n_docs, n_terms, k), "ranking-found") for b in range(blocks if n_docs else 0)]
    best = found[0] if found else index.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for more in found[1:]:
        best = best.unionByName(more)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
