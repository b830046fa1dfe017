"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed to one of BINS bins with a value in [i, i + 1); a bin keeps its least
value, so late rounds only fill bins that are still empty. Bins empty after BINS rounds take the least of one more
hash of all shingles, which fills every coordinate. Coordinates of two sets agree with the probability of their
similarity, with concentration as of that many independent hashes. Each coordinate keeps one byte.

Documents of equal sets are one class, told by a digest; only class representatives are compared. Bands of sketch
bytes put representatives into buckets, which are searched without pairing all their members (see near_duplicates).
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, forget, stored
from docketspark.llm.grouping import forest, runs

by_value(__name__)

BINS, BAND_ROWS, BANDS = 256, 6, 42
#: Pairs whose sketches agree in this share less than the threshold are not verified: six deviations of BINS coordinates.
MARGIN = 0.15
#: Values of a hash of doc_id by which rows that need verification are told apart before their texts move. A bound of the broadcast, not of the rows.
SIEVE = 1 << 18
#: Items of a band, and shingles of theirs, at most about so many in a block.
BLOCK_ITEMS, BLOCK_WEIGHT = 1024, 1_000_000

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _K)


class WordHashes(dict):
    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words; of fewer words one shingle; of none none."""
    tokens = (text or b"").lower().split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    if len(h) < size:
        out = np.zeros(1, np.uint64)
        for x in h:
            out = mix(out * _K + x)
        return out
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * _K + h[k : k + n])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS bytes."""
    least, n, i = np.full(BINS, _EMPTY), len(shingles), 0
    step = max(1, -(-BINS * 7 // n))
    while i < BINS and (i == 0 or (least == _EMPTY).any()):
        rounds = np.arange(i, min(i + step, BINS), dtype=np.uint64)
        h = mix(shingles[None, :] ^ _SEEDS[rounds.astype(int), None])
        np.minimum.at(least, (h & np.uint64(BINS - 1)).astype(np.intp).ravel(), ((rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))).ravel())
        i += step
    for b in np.flatnonzero(least == _EMPTY):
        least[b] = np.uint64(BINS + b) << np.uint64(48) | mix(shingles ^ _SEEDS[BINS + b]).min() >> np.uint64(16)
    return (least & np.uint64(255)).astype(np.uint8)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest and sketch of every row; the latter two null without words."""

    def signed(batches):
        words = WordHashes()
        for b in batches:
            n, digests, sketches = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, size, words)
                n.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n_shingles long, digest binary, sketch binary")


def bands(reps: DataFrame) -> DataFrame:
    """band, id, n: one row a representative and band; the last six bits of band are its number."""
    key = lambda b: F.xxhash64(F.substring("sketch", b * BAND_ROWS + 1, F.lit(BAND_ROWS)), b)
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.shiftleft(F.shiftright(key(b), 6), 6) + b)
    return reps.select(F.explode(keys).alias("band"), "id", "n")


def least_agreement(percent: int) -> int:
    """Coordinates in which two sketches must agree to be looked at further."""
    return int(np.ceil((percent / 100 - MARGIN) * BINS))


def star_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b of members (band, id, lo) and the least id of each of their bands, if their sketches agree enough."""
    los = members.where("id > lo").groupBy("id").agg(F.collect_set("lo").alias("los"))  # BANDS at most
    right = los.join(reps.select("id", F.col("sketch").alias("bs")), "id").select(F.col("id").alias("b"), "bs", F.explode("los").alias("a"))
    both = right.join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("as")), "a")
    least = least_agreement(percent)

    def kept(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("as", "bs"))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "as", "bs").mapInArrow(kept, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id and data (the sorted hashes of its shingles) of the documents named by ids (id), stored."""
    sieve = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    # At most SIEVE rows of one number are broadcast, whatever the corpus; the join by id below is exact.
    few = docs.join(F.broadcast(ids.select(sieve("id").alias("_nd_s")).distinct()), sieve("doc_id") == F.col("_nd_s"), "left_semi")

    def sets(batches):
        words = WordHashes()
        for b in batches:
            got = [shingle_set(t, size, words).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], names=["id", "data"])

    full = few.select("doc_id", "text").mapInArrow(sets, "id long, data binary").where("length(data) > 0")
    return stored(full.join(ids, "id", "left_semi"), "neardup-sets")


def confirmed(close: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of close (stored) with 100 * intersection >= percent * union of their full sets, stored."""
    full = full_sets(close.select(F.explode(F.array("a", "b")).alias("id")), docs, size)

    def checked(batches):
        for t in batches:
            good = []
            for x, y in zip(t.column("ax").to_pylist(), t.column("bx").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: full.select(F.col("id").alias(x), F.col("data").alias(f"{x}x"))
    links = stored(close.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ax", "bx").mapInArrow(checked, "a long, b long"), "neardup-links")
    forget(full)
    return links


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, id, n, c, blocks of the members of bands that span several components c, stored."""
    own = members.join(labels, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("c"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ITEMS), F.ceil(F.sum("n") / BLOCK_WEIGHT)).cast("int").alias("blocks")
    span = own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), blocks).where("low < high")
    return stored(own.join(span.select("band", "blocks"), "band"), "neardup-open")


CELL = ["band", "k", "i", "j", "part"]


def cells(open_: DataFrame, percent: int) -> DataFrame:
    """CELL, id, c, n: where the members of open bands are held against each other.

    Sets with 100 * intersection >= percent * union differ in size by a factor of 100 / percent at most. A band is
    cut by size into classes k of that factor, so a class meets itself and the next one only. Where a band has
    several blocks, items are dealt to them by hash and cell i, j holds block i of class k (part 0) and block j of
    what it meets (part 1), so an item is copied about three times for each block of its band.
    """
    width = math.log(100 / percent) * 1.0001 + 1e-6  # a hair wider, for rounding
    k, last = F.floor(F.log(F.col("n")) / width).cast("int"), F.col("blocks") - 1
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    at = lambda k, i, j, part: F.struct(k.alias("k"), i.alias("i"), j.alias("j"), F.lit(part).alias("part"))
    every = F.sequence(F.lit(0), last)
    left = F.transform(every, lambda j: at(F.col("k"), F.col("own"), j, 0))
    right = F.transform(F.filter(every, lambda i: i < F.col("own")), lambda i: at(F.col("k"), i, F.col("own"), 1))
    above = F.transform(every, lambda i: at(F.col("k") - 1, i, F.col("own"), 1))
    placed = open_.withColumn("k", k).withColumn("own", own)
    return placed.select("band", F.explode(F.concat(left, right, above)).alias("x"), "id", "c", "n").select("band", "x.*", "id", "c", "n")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL[:4]).sortWithinPartitions(*CELL, "id")


def partnered(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of cells whose sketch agrees enough with one of another component in their cell; at most as many as come in.

    Two sketches of several common bands count in the first of these only, which is open as well.
    """
    least = least_agreement(percent)

    def found(batches):
        for t, bounds in runs(batches, 4):
            part, c, n = (t.column(x).to_numpy() for x in ("part", "c", "n"))
            keep = np.zeros(t.num_rows, bool)
            sketches = t.column("sketch")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                m = a + int(np.count_nonzero(part[a:b] == 0))
                if m == a or b - a < 2 or (c[a:b] == c[a]).all():
                    continue
                s = np.frombuffer(b"".join(sketches[a:b].to_pylist()), np.uint8).reshape(-1, BINS)
                i, j, own = t.column("i")[a].as_py(), t.column("j")[a].as_py(), t.column("band")[a].as_py() & 63
                parts = s[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
                for x in range(m - a):
                    y0 = x + 1 if i == j else m - a  # block i of part 0 meets itself in cell i, i
                    good = (s[y0:] == s[x]).sum(1) >= least
                    good &= (c[a + y0 : b] != c[a + x]) & (percent * np.maximum(n[a + y0 : b], n[a + x]) <= 100 * np.minimum(n[a + y0 : b], n[a + x]))
                    y = y0 + np.flatnonzero(good)
                    y = y[(parts[y] == parts[x]).all(2).argmax(1) == own]
                    if len(y):
                        keep[a + x] = True
                        keep[a + y] = True
            yield from t.select([*CELL, "id", "c"]).filter(pa.array(keep)).to_batches()

    rows = rows.join(reps.select("id", "sketch"), "id").select(*CELL, "id", "c", "n", "sketch")
    return _sorted(rows).mapInArrow(found, "band long, k int, i int, j int, part int, id long, c long")


def compare_sets(left: list, right: list, percent: int, itself: bool, columns: int = 4096) -> list[tuple[int, int]]:
    """Each two components (a < b) with a link in lists of (component, set bytes): left against right, and against itself if so said. Sizes of all intersections come from products of incidence matrices, `columns` shingles at a time."""
    items = left + right
    if not left or len({c for c, _ in items}) < 2:
        return []
    sets = [np.frombuffer(d, np.uint64) for _, d in items]
    n = np.array([len(s) for s in sets])
    row, every = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column, count = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(every)))
    shared = count[column] > 1  # a shingle of one set is in no intersection
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], np.diff(column) != 0)))  # numbered anew; sorted as before
    k, from_ = len(left), 0 if itself else len(left)
    both = np.zeros((k, len(items) - from_), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        there = np.zeros((len(items), columns), np.float32)
        there[row[a:b], column[a:b] - at] = 1
        both += (there[:k] @ there[from_:].T).astype(np.int64)  # sums of at most `columns` ones are exact
    c = np.array([c for c, _ in items])
    good = (100 * both >= percent * (n[:k, None] + n[None, from_:] - both)) & (c[:k, None] != c[None, from_:])
    return list({(min(c[x], c[from_ + y]), max(c[x], c[from_ + y])) for x, y in zip(*np.nonzero(good), strict=True)})


def cell_links(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: components with a link between rows (CELL, id, c; stored) of one cell, stored."""
    full = full_sets(rows.select("id"), docs, size)

    def compared(batches):
        for t, bounds in runs(batches, 4):
            part, c, i, j = (t.column(x).to_numpy() for x in ("part", "c", "i", "j"))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                items = list(zip(c[a:b].tolist(), t.column("data")[a:b].to_pylist(), strict=True))
                m = int(np.count_nonzero(part[a:b] == 0))
                out += compare_sets(items[:m], items[m:], percent, bool(i[a] == j[a]))
            yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], names=["a", "b"])

    links = stored(_sorted(rows.join(full, "id").select(*CELL, "id", "c", "data")).mapInArrow(compared, "a long, b long"), "neardup-links")
    forget(full)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
    size words (fewer words are one shingle). Documents with 100 * intersection >= percent * union are linked;
    component_id is the least doc_id reachable, kept tells whether it is the row's own. Null, empty and wordless
    texts have no shingles and are linked with nothing. Copies share their class's component; repeated rows of a
    doc_id all appear, kept alike. Where one doc_id has several texts, classes that it is the least of count as
    one document, with the links of any of its texts. Rows without a doc_id take the component of their copies, null without
    any. An empty table gives an empty result; extra columns don't matter. A link of similarity 0.8 is missed with
    probability below 1e-5.

    Members of a band are first held against its least id, which links most groups with as many pairs as members.
    What of a band is then still in several components meets in cells, first by sketches, then by full sets; only
    links come out of these tasks, so no group is paired out, and no link between components is missed.
    """
    texts = docs.select("doc_id", "text")
    signed = stored(signatures(docs, size), "neardup-signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = stored(classes.where("id is not null"), "neardup-reps")
    rows = bands(reps)
    ends = rows.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = stored(rows.join(ends.select("band", "lo"), "band"), "neardup-members")
    close = stored(star_pairs(members, reps, percent), "neardup-close")
    links = confirmed(close, texts, size, percent)
    labels = forest(links)
    open_ = open_members(members, labels)
    forget(members, close, links)
    some = stored(partnered(cells(open_, percent), reps, percent), "neardup-cells")
    found = cell_links(some, texts, size, percent)
    joined = forest(found).select(F.col("id").alias("_nd_c"), F.col("component").alias("_nd_d"))
    whole = reps.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("_nd_c"))
    whole = whole.join(joined, "_nd_c", "left").select("digest", F.coalesce("_nd_d", "_nd_c").alias("_nd_c"))
    forget(open_, some, found)
    # A class of very many copies is split by the skewed join: nothing is grouped behind it.
    out = signed.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("_nd_c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one a doc_id, and all without words; columns as in docs."""
    keep = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_nd_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(F.col("_nd_id")), "left_semi")
