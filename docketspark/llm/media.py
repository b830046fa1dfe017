"""Media columns: chroma fingerprints of audio, and the alignment of recordings by them.

A recording's spectrum is folded into twelve pitch classes a frame. Sixteen filters, differences of areas of that
image read from its integral image, slide over it; each gives two bits, and the 32 bits of a position are one packed
integer. Recordings are searched for by parts of these integers: KEY_BITS of the 32 bits, taken at TURNS places, so
that a position with a few wrong bits still votes. Votes make a histogram of offsets for two recordings, and offsets
with LEAST_VOTES are held to the share of bits that really differ there.
"""

from __future__ import annotations

import io
import wave
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, stored
from docketspark.llm.grouping import runs

by_value(__name__)

FRAME, HOP = 512, 256
#: Frames that a fingerprint integer looks at.
SPAN = 16
#: Filters by rule: kind, first pitch class, pitch classes, frames.
FILTERS = [(k % 4, 5 * k % (13 - (4 + k % 5)), 4 + k % 5, (SPAN, SPAN, 8, 12)[k // 4]) for k in range(16)]
#: A filter's value is coded by where it lies to -STEP, 0 and STEP.
STEP = 0.3
#: Most bits that may differ, in hundredths, and least number of integers that must overlap.
MOST_ERRORS, LEAST_OVERLAP = 20, 40
#: Frames below this root-mean-square amplitude (full scale 1) are silence.
SILENCE = 1e-3
#: Bits of a key, how many keys an integer has, and votes that an offset needs.
KEY_BITS, TURNS, LEAST_VOTES = 20, 4, 2
#: Rows whose rec_id is divisible by this ask.
EVERY = 20
#: Positions of a block of asking recordings and of a part of all, at most about so many; votes or positions that are looked at together.
BLOCK_PRINTS, PART_PRINTS, AT_ONCE = 1 << 19, 1 << 17, 1 << 20


def samples(audio: bytes) -> tuple[np.ndarray, int]:
    """Mono samples within -1..1 and the rate of a 16-bit PCM WAVE file."""
    with wave.open(io.BytesIO(audio)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return raw.reshape(-1, w.getnchannels()).mean(1), w.getframerate()


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """frames x 12; a frame sums to 1, a silent one to 0."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= 100) & (hz <= 5000)
    fold = np.zeros((len(hz), 12))
    fold[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    out = power @ fold
    out[np.sqrt((frames * frames).mean(1)) < SILENCE] = 0
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """uint32 for each position of a window of SPAN frames; 0 where all of it is silent. None, broken and short files have none."""
    try:
        image = chroma(*samples(audio or b""))
    except (wave.Error, EOFError):
        return np.zeros(0, np.uint32)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, p0, p1):
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, low, high, width in FILTERS:
        p0, p1, mid, half = low, low + high, low + high // 2, width // 2
        whole = area(0, width, p0, p1)
        if kind == 0:  # lower against upper pitches
            part = area(0, width, p0, mid)
        elif kind == 1:  # earlier against later
            part = area(0, half, p0, p1)
        elif kind == 2:  # opposite corners
            part = area(0, half, p0, mid) + area(half, width, mid, p1)
        else:  # the middle against both sides
            part = area(width // 4, width - width // 4, p0, p1)
        value = np.log((1 + part) / (1 + whole - part))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbours differ in one bit
    out[area(0, SPAN, 0, 12) == 0] = 0
    return out


def turned(prints: np.ndarray) -> np.ndarray:
    """TURNS x positions: keys of KEY_BITS bits, of every integer turned by so many bits; a key tells its turn."""
    p, step = prints.astype(np.uint64), 32 // TURNS
    both = [p << np.uint64(step * k) | p >> np.uint64(32 - step * k) for k in range(TURNS)]
    return np.stack([(x & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64) | k << KEY_BITS for k, x in enumerate(both)])


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, size[0] of them, then the same for begin[1]."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def errors_at(x: np.ndarray, y: np.ndarray, x0: np.ndarray, y0: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, compared bits) of x[x0 :][: n] and y[y0 :][: n] for each x0, y0 and n; where both are silent nothing is compared."""
    errors, compared = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    upto, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        a, b = x[gathered(x0[at:to], n[at:to])], y[gathered(y0[at:to], n[at:to])]
        some = np.flatnonzero(n[at:to])
        if len(some):
            starts = (np.cumsum(n[at:to]) - n[at:to])[some]
            errors[at + some] = np.add.reduceat(np.bitwise_count(a ^ b), starts, dtype=np.int64)
            compared[at + some] = 32 * np.add.reduceat((a | b) != 0, starts, dtype=np.int64)
        at = to
    return errors, compared


class Index:
    """Recordings (id, prints) by the keys of their integers."""

    def __init__(self, items: list[tuple[int, bytes]]):
        prints = [np.frombuffer(p, "<u4") for _, p in items]
        self.ids, self.lengths = np.array([i for i, _ in items], np.int64), np.array([len(p) for p in prints], np.int64)
        self.flat, self.begins = np.concatenate(prints), np.cumsum(self.lengths) - self.lengths
        keys, sounding = turned(self.flat), self.flat != 0
        keys = keys[:, sounding].ravel()
        order = np.argsort(keys, kind="stable")
        self.count = np.bincount(keys, minlength=TURNS << KEY_BITS)
        self.first = np.cumsum(self.count) - self.count
        at = np.flatnonzero(sounding)[order % max(1, int(sounding.sum()))]
        self.owner = np.repeat(np.arange(len(items)), self.lengths)[at]
        self.place = at - self.begins[self.owner]

    def search(self, ids: np.ndarray, prints: list[np.ndarray], most_errors: int, least_overlap: int):
        """Arrays (own recording's number, i, offset, differing bits, compared bits) of all alignments of own recordings and prints[i]: of two that align, the best offset that the histogram of votes names."""
        lengths = np.array([len(p) for p in prints], np.int64)
        flat, begins = np.concatenate(prints), np.cumsum(lengths) - lengths
        keys = turned(flat)
        votes = np.where(flat != 0, self.count[keys], 0)
        upto = np.concatenate(([0], np.cumsum(votes.sum(0))))
        ends, at, width = upto[begins + lengths], 0, int(self.lengths.max() + lengths.max())
        while at < len(prints):
            to = max(at + 1, int(np.searchsorted(ends, upto[begins[at]] + AT_ONCE, "right")))
            part = slice(begins[at], begins[to - 1] + lengths[to - 1])
            own = np.repeat(np.arange(at, to), lengths[at:to])
            place = np.arange(len(own)) - np.repeat(begins[at:to] - begins[at], lengths[at:to])
            n = votes[:, part].ravel()
            post = gathered(self.first[keys[:, part].ravel()], n)
            pair = np.repeat(np.tile(own, TURNS), n) * len(self.ids) + self.owner[post]
            code = np.sort(pair * width + np.repeat(np.tile(place, TURNS), n) - self.place[post] + self.lengths.max())
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else code
            code = code[starts[np.diff(np.append(starts, len(code))) >= LEAST_VOTES]]
            i, q, offset = code // width // len(self.ids), code // width % len(self.ids), code % width - self.lengths.max()
            apart = self.ids[q] != ids[i]
            i, q, offset = i[apart], q[apart], offset[apart]
            low = np.maximum(0, -offset)
            n = np.minimum(self.lengths[q], lengths[i] - offset) - low
            long_ = n >= least_overlap
            i, q, offset, low, n = i[long_], q[long_], offset[long_], low[long_], n[long_]
            errors, compared = errors_at(self.flat, flat, self.begins[q] + low, begins[i] + low + offset, n)
            good = np.flatnonzero((compared >= 32 * least_overlap) & (100 * errors <= most_errors * compared))
            good = good[np.lexsort((offset[good], -compared[good], errors[good] / compared[good], q[good], i[good]))]
            pair = i[good] * len(self.ids) + q[good]
            good = good[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(good) else good
            yield q[good], i[good], offset[good], errors[good], compared[good]
            at = to


def fingerprints(media: DataFrame) -> DataFrame:
    """rec_id, n_prints, digest, prints of media (rec_id, audio)."""

    def taken(batches):
        for b in batches:
            prints = [fingerprint(x.as_py()) for x in b.column("audio")]  # one file at a time
            raw = [p.astype("<u4").tobytes() for p in prints]
            digest = [blake2b(r, digest_size=16).digest() if p.any() else None for p, r in zip(prints, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array([len(p) for p in prints], pa.int64()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["rec_id", "n_prints", "digest", "prints"])

    return media.select("rec_id", "audio").mapInArrow(taken, "rec_id long, n_prints long, digest binary, prints binary")


FOUND = ["id", "n_links", "aligned_to", "offset", "bit_errors", "compared_bits"]


def _found(index: Index, ids: np.ndarray, prints: list[np.ndarray], most_errors: int, least_overlap: int) -> list[tuple]:
    """FOUND of every recording of the index that has an alignment with one of prints."""
    best, count = {}, {}
    for q, i, *rest in index.search(ids, prints, most_errors, least_overlap):
        for own, other, offset, errors, compared in zip(index.ids[q].tolist(), ids[i].tolist(), *(x.tolist() for x in rest), strict=True):
            count[own] = count.get(own, 0) + 1
            best[own] = min(best.get(own, (2,)), (errors / compared, other, offset, errors, compared))
    return [(own, count[own], *best[own][1:]) for own in best]


def searched(reps: DataFrame, most_errors: int = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """FOUND of every asking row of reps (id, prints, asked) that aligns with another: its number of alignments, and the best one.

    reps (stored) is dealt by hash to parts, its asking rows to blocks, both of bounded size. Every block meets every
    part in a cell: the block is indexed there and the part's recordings vote. So each row moves once for every block,
    each asking row once for every part, and cells return a row an asking recording at most.
    """
    least_overlap, n = max(1, least_overlap), F.expr("length(prints) div 4")
    reps = reps.where(n >= least_overlap)
    asked, every = reps.agg(F.sum(F.when(F.col("asked"), n)), F.sum(n)).first()
    blocks, parts = (max(1, -(-(x or 0) // size)) for x, size in ((asked, BLOCK_PRINTS), (every, PART_PRINTS)))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(int(count) - 1)))
    queries = reps.where("asked").select(dealt(blocks).alias("block"), all_of(parts).alias("part"), F.lit(0).alias("side"), "id", "prints")
    others = reps.select(all_of(blocks).alias("block"), dealt(parts).alias("part"), F.lit(1).alias("side"), "id", "prints")
    cells = queries.union(others).repartition("block", "part").sortWithinPartitions("block", "part", "side", "id")

    def held(batches):
        for t, bounds in runs(batches, 2):
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                m = int((t.column("side").to_numpy()[a:b] == 0).sum())
                ids, raw = t.column("id").to_numpy()[a:b], t.column("prints")[a:b].to_pylist()
                if 0 < m < b - a:
                    index = Index(list(zip(ids[:m].tolist(), raw[:m], strict=True)))
                    out += _found(index, ids[m:], [np.frombuffer(p, "<u4") for p in raw[m:]], most_errors, least_overlap)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(FOUND))], names=FOUND)

    found = cells.mapInArrow(held, ", ".join(f"{c} long" for c in FOUND))
    best = F.min(F.struct((F.col("bit_errors") / F.col("compared_bits")).alias("r"), *FOUND[2:])).alias("m")
    return found.groupBy("id").agg(F.sum("n_links").alias("n_links"), best).select("id", "n_links", *[f"m.{c}" for c in FOUND[2:]])


def align_recordings(media: DataFrame, every: int = EVERY, most_errors: int = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """rec_id, n_prints, class_id, n_links, aligned_to, offset, bit_errors, compared_bits for every row of media.

    media: rec_id (long) and audio (16-bit PCM WAVE bytes). class_id: the least rec_id with the same fingerprint.
    Rows whose rec_id is divisible by `every` are searched for among all recordings: n_links is the number of other
    fingerprints that align with theirs within the bounds, and the last four name the alignment with the least share
    of differing bits (then the least rec_id): print i sounds with print i + offset of aligned_to. These are null for
    rows that do not ask, n_links is 0 and the rest null without an alignment. Null, broken, silent and too short
    files have no class but themselves and align with nothing; rows without a rec_id take the class of their copies;
    repeated rows all appear; an empty table gives an empty result; other columns don't matter.
    """
    prints = stored(fingerprints(media), "media-prints")
    asks = F.coalesce(F.col("rec_id") % every == 0, F.lit(False))
    classes = prints.where("digest is not null").groupBy("digest").agg(F.min("rec_id").alias("id"), F.first("prints").alias("prints"), F.max(asks).alias("asked"))
    classes = stored(classes.where("id is not null"), "media-classes")
    whole = classes.select("digest", "id").join(searched(classes, most_errors, least_overlap), "id", "left")
    out = prints.select("rec_id", "n_prints", "digest", asks.alias("asks")).join(whole, "digest", "left")
    own = [F.when(F.col("asks"), F.col(c)).alias(c) for c in FOUND[2:]]
    n_links = F.when(F.col("asks"), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links")
    return out.select("rec_id", "n_prints", F.coalesce("id", "rec_id").alias("class_id"), n_links, *own)


# --- recordings for tests and for the query ---------------------------------------------------------------------

RATE, NOTE = 4000, 512


def tune(pitches, silent_notes: int = 0) -> bytes:
    """A WAVE file that plays pitches (semitones above 330 Hz), one NOTE of samples each, after some silence."""
    t = np.arange(NOTE) / RATE
    ring = np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 32)
    sound = [np.sin(2 * np.pi * 330 * 2 ** (p / 12) * t) * ring for p in pitches]
    x = np.concatenate([np.zeros(silent_notes * NOTE), *sound])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 12000).astype("<i2").tobytes())
    return out.getvalue()


def rendered(vectors: DataFrame) -> DataFrame:
    """rec_id, audio: each vector (vec_id, embedding) played as a tune of its values, after vec_id mod 4 silent notes."""

    def played(batches):
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            audio = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                z = np.nan_to_num(np.array(v or [], float))
                z = z / (z.std() or 1)
                audio.append(tune(np.clip(np.round(2.5 * z) + 6, 0, 11), (i or 0) % 4))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(played, "rec_id long, audio binary")
