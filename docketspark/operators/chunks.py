"""Chunks of texts with lineage (additional: from the specification of later blocks).

A text is cut at sentence ends into chunks of LEAST to MOST words. Dynamic programming over the sentences finds the
cuts of least cost: each cut costs the likeness of the sentences on its sides, and a chunk outside the bounds costs
more than any cut for every word that it is off. Chunks tile the text: every code point is in exactly one.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, MOST = 400, 800
#: Sentences on either side of a cut that are held against each other, and the price of a word outside the bounds; a cut costs 0 to 1000.
NEAR, OFF = 3, 1001
#: A sentence without an end is cut after so many words.
LONG = 100
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = re.compile(r".*?(?:(?:[.!?]+(?=[\x20\x09-\x0D])|\n)[\x20\x09-\x0D]*|\Z)", re.DOTALL)


def sentences(text: str) -> tuple[np.ndarray, list[set[str]], np.ndarray]:
    """(ends, in code points; the distinct words, lower-cased; the number of words) of sentences that tile the text. Runs of LONG words without an end are sentences, too."""
    ends, words, n = [], [], []
    for m in SENTENCE.finditer(text):
        if m.end() == m.start():
            continue
        own = list(WORD.finditer(text, m.start(), m.end()))
        parts = [own[i : i + LONG] for i in range(0, len(own), LONG)] or [[]]
        for part, after in zip(parts, [*parts[1:], None], strict=True):
            ends.append(after[0].start() if after else m.end())
            words.append({w.group().lower() for w in part})
            n.append(len(part))
    return np.array(ends, np.int64), words, np.array(n, np.int64)


def likeness(words: list[set[str]]) -> np.ndarray:
    """For each cut before sentence i (0 to n): a thousand times the Jaccard similarity of the NEAR sentences before and after; 0 at both ends of the text."""
    out = np.zeros(len(words) + 1, np.int64)
    for i in range(1, len(words)):
        a, b = set().union(*words[max(0, i - NEAR) : i]), set().union(*words[i : i + NEAR])
        out[i] = 1000 * len(a & b) // max(1, len(a | b))
    return out


def off(n: np.ndarray, least: int, most: int) -> np.ndarray:
    """What chunks of so many words cost."""
    return OFF * (np.maximum(least - n, 0) + np.maximum(n - most, 0))


def cuts(n: np.ndarray, like: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of chunks, in sentences, of least cost; of equal ones that of the longest last chunk, and so on forward.

    A chunk that holds more than twice `most` words in more than one sentence is never better than its halves, so
    each step looks back that far at most: the time is linear in the text.
    """
    k = len(n)
    upto = np.append(0, np.cumsum(n))
    cost, back = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
    for i in range(1, k + 1):
        low = min(int(np.searchsorted(upto, upto[i] - 2 * (most + least), "left")), i - 1)
        total = cost[low:i] + like[low:i] + off(upto[i] - upto[low:i], least, most)
        j = int(total.argmin())
        cost[i], back[i] = total[j], low + j
    out, i = [], k
    while i:
        out.append(i)
        i = int(back[i])
    return out[::-1]


def chunked(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, source, version, chunk, start, end, n_words, text: the chunks of every row of docs (doc_id, source, text).

    version is the SHA-256 of the whole text that start and end (code points, end exclusive) refer to; chunk counts
    from 0. Null and empty texts have no chunk; texts of fewer than `least` words are one. Repeated rows appear as
    often as they come; null doc_ids and sources stay null; other columns don't matter.
    """

    def cut(batches):
        for b in batches:
            at, rows = [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                if not text:
                    continue
                ends, words, n = sentences(text)
                start, first = 0, 0
                for i, c in enumerate(cuts(n, likeness(words), least, most)):
                    end = int(ends[c - 1])
                    at.append(row)
                    rows.append((i, start, end, int(n[first:c].sum()), text[start:end]))
                    start, first = end, c
            kept = b.select(["doc_id", "source", "version"]).take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "source", "version", "chunk", "start", "end", "n_words", "text"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, version string, chunk int, start long, end long, n_words long, text string"
    return docs.select("doc_id", F.col("source").cast("string"), F.sha2(F.col("text").cast("binary"), 256).alias("version"), "text").mapInArrow(cut, schema)
