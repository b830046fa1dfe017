"""Near duplicates by simhash: anchor-point covering and comparison at each anchor.

A document's fingerprint has a bit where over half of its shingles' hashes have it. The anchors are the words of a
covering code, an extended BCH code of 64 bits. A fingerprint lives at its nearest anchor, r bits away, r being the
code's covering radius at most. Of two fingerprints at most d bits apart let x be the one with the smaller r: the
other lies at most r(x) + d <= r(y) + d from x's anchor. So every fingerprint visits all anchors within its own r plus d,
never further than the covering radius plus d, and each link is seen at the home of one of its ends.

Equal fingerprints are one class, compared once. An anchor with many fingerprints deals those at home into blocks; its
visitors go to each block. A task unites what it finds linked and gives the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, forget, stored
from docketspark.llm.grouping import forest, runs

by_value(__name__)

SEED = 42
#: Fingerprints at home in a block of an anchor, about.
BLOCK = 4096
#: Information bits of the code, by the least number of different fingerprints: 2^10, 2^16 or 2^18 anchors, of which a
#: fingerprint visits more, but meets one in 34, 450 or 1,500 of the others. The choice changes no result.
CODES = {0: 10, 4_000_000: 16, 400_000_000: 18}


# --- fingerprints ---------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None, size: int) -> int:
    """Bits that over half of the hashes of the text's shingles have, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - size + 1
    hashes = np.array([xx(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def signed(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(signed, "doc_id long, fp long")


# --- anchors --------------------------------------------------------------------------------------------------


@cache
def bch(k: int) -> np.ndarray:
    """All 2^k words of the extended BCH code of 64 bits with k information bits (7, 10, 16, 18 or 24), as integers.

    The generator polynomial has the roots a, a^2, a^3 ... of GF(64) up to where only k information bits are left.
    """
    power = [1]
    for _ in range(62):
        x = power[-1] << 1
        power.append(x ^ 0b1000011 if x & 64 else x)
    log = {x: i for i, x in enumerate(power)}
    roots: set[int] = set()
    for i in range(1, 63):
        if 63 - len(roots) <= k:
            break
        roots |= {i * 2**j % 63 for j in range(6)}
    if 63 - len(roots) != k:
        raise ValueError(f"no BCH code of length 63 has {k} information bits")
    poly = [1]  # coefficients in GF(64), lowest first
    for r in roots:
        times = [0 if not c else power[(log[c] + r) % 63] for c in poly]
        poly = [(times[i] if i < len(poly) else 0) ^ (poly[i - 1] if i else 0) for i in range(len(poly) + 1)]
    generator = sum(c << i for i, c in enumerate(poly))
    words = np.zeros(1, np.uint64)
    for shift in range(k):
        row = generator << shift
        row |= (row.bit_count() & 1) << 63
        words = np.concatenate((words, words ^ np.uint64(row)))
    return words


def anchors(fps: np.ndarray, k: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint's position, anchor's number, home) of all anchors within each fingerprint's nearest anchor plus `distance`; home: the nearest, the first of these."""
    words, out = bch(k), []
    for at in range(0, len(fps), step := max(1, (1 << 20) // len(words))):
        far = np.bitwise_count(fps[at : at + step, None] ^ words[None, :])
        home = far.argmin(1)
        i, j = np.nonzero(far <= far[np.arange(len(far)), home, None] + np.uint8(distance))
        out.append((i + at, j, j == home[i]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def visits(classes: DataFrame, k: int, distance: int) -> DataFrame:
    """anchor, home, fp, id: a row for each class (fp, id) and anchor that it visits; home at its own."""

    def placed(batches):
        for b in batches:
            fps, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "id"))
            for at in range(0, len(fps), 4096):
                fp, own = fps[at : at + 4096], ids[at : at + 4096]
                i, anchor, home = anchors(fp.view(np.uint64), k, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(home), pa.array(fp[i]), pa.array(own[i])], names=["anchor", "home", "fp", "id"])

    return classes.mapInArrow(placed, "anchor long, home boolean, fp long, id long")


def joined(own: np.ndarray, visiting: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions in own, then visiting after it) of a spanning forest of the links with an end in own.

    Breadth first: each fingerprint at home is held against those that no one has reached yet, so a dense group is
    used up by its first few members.
    """
    every = np.concatenate((own, visiting))
    left, out = np.arange(len(every)), []
    for start in range(len(own)):
        at = np.searchsorted(left, start)
        if at == len(left) or left[at] != start:
            continue
        queue, left = [start], np.delete(left, at)
        while queue:
            x = queue.pop()
            near = np.bitwise_count(every[left] ^ every[x]) <= distance
            if x >= len(own):
                near &= left < len(own)
            got = left[near]
            if len(got):
                left = left[~near]
                out.append((np.full(len(got), x), got))
                queue += got.tolist()
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def links(classes: DataFrame, distance: int, k: int) -> DataFrame:
    """a, b: ids of classes (fp, id) at most `distance` bits apart, enough of them to join what is joined; stored."""
    rows = stored(visits(classes, k, distance), "simhash-visits")
    crowd = rows.where("home").groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(crowd, "anchor")  # visitors of an anchor without a home go nowhere
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # At home in its own block, a visitor of those before it: two at home of one anchor meet once.
    cells = F.when(F.col("home"), F.filter(every, lambda b: b <= own)).otherwise(every)
    placed = placed.select("anchor", F.explode(cells).alias("cell"), "home", "fp", "id", own.alias("own"))
    placed = placed.withColumn("home", F.col("home") & (F.col("own") == F.col("cell"))).drop("own")

    def compared(batches):
        for t, bounds in runs(batches, 2):
            home, fp, ids = (t.column(c).to_numpy() for c in ("home", "fp", "id"))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                here, there = a + np.flatnonzero(home[a:b]), a + np.flatnonzero(~home[a:b])
                if len(here) and b - a > 1:
                    every = np.concatenate((here, there))
                    x, y = joined(fp[here].view(np.uint64), fp[there].view(np.uint64), distance)
                    out.append((ids[every[x]], ids[every[y]]))
            got = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], names=["a", "b"])

    dealt = placed.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "id")
    found = stored(dealt.mapInArrow(compared, "a long, b long").where("a != b"), "simhash-links")
    forget(rows)
    return found


def simhash_components(docs: DataFrame, size: int = 5, distance: int = 3, k: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; shingles of size words, repeats included, are joined by
    a space (fewer words are one shingle) and hashed by XXH64. Documents whose fingerprints differ in at most
    `distance` bits are linked; component_id is the least doc_id reachable. Null, empty and wordless texts have the
    fingerprint zero and are linked like any other. Repeated rows all appear. Rows without a doc_id take the
    component of their fingerprint's class, null if no row of it has one, and join no classes. Where one doc_id has
    several texts, their classes count as one where it is the least of both. An empty table gives an empty
    result; other columns don't matter. k: information bits of the anchors' code; by the number of fingerprints if not given.
    """
    signed = stored(fingerprints(docs, size), "simhash-signed")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    own = classes.where("id is not null")
    if k is None:
        n = own.count()
        k = max((least, bits) for least, bits in CODES.items() if least <= n)[1]
    found = links(own, distance, k)
    labels = forest(found)
    whole = classes.join(labels, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    forget(found)
    # A fingerprint of very many rows is split by the skewed join: nothing is grouped behind it.
    out = signed.join(whole, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
