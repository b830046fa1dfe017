"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer numpy network.

One pass over the whole corpus gives every word the sum of its neighbours' sparse random vectors. Words fall into
WORD_UNITS hashed units and their shapes (letters, capitals, digits and symbols in runs) into SHAPE_UNITS more, so
the vectors are one table of fixed size: each task adds up its own integer table, Spark sums the tables by unit,
and the sum (UNITS x DIM integers, about 4 MB whatever the corpus) is broadcast. A document is pooled to the mean
and the spread of its vectors. The network learns from a bounded sample of labelled documents and its logits are
divided by a temperature fitted on a part of that sample kept aside.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value

by_value(__name__)

WORD_UNITS, SHAPE_UNITS, DIM = 1 << 15, 1 << 11, 32
UNITS = WORD_UNITS + SHAPE_UNITS
#: Labelled documents that the network sees at most: those with the smallest hash of doc_id.
SAMPLE = 20_000
KEEP_AT = 0.7
#: Words at a time: counting adds to a whole table each time, pooling works on a vector for each word, which small chunks keep in the processor's cache.
COUNT_WORDS, POOL_WORDS = 1 << 18, 1 << 13
FEATURES = 4 * DIM + 4
#: Bytes of a word: a longer run without white space is so many words.
LONGEST = 64

_SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


class Units(dict):
    """word (bytes) -> word unit | shape unit << 16, remembered for a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        shape = word.translate(_SHAPE)
        runs = bytes(b for i, b in enumerate(shape) if i == 0 or b != shape[i - 1])
        code = zlib.crc32(word.lower()) % WORD_UNITS | (WORD_UNITS + zlib.crc32(runs) % SHAPE_UNITS) << 16
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code
        return code


def chunks(texts: list, units: Units, most: int):
    """(first row, units of the words, words of each row) for runs of rows with about `most` words."""
    rows, first, n = [], 0, 0
    for i, text in enumerate(texts):
        row = (text or b"").split()
        if row and max(map(len, row)) > LONGEST:
            row = [w[at : at + LONGEST] for w in row for at in range(0, len(w), LONGEST)]
        rows.append(row)
        n += len(rows[-1])
        if n >= most or i == len(texts) - 1:
            code = np.fromiter(map(units.__getitem__, chain.from_iterable(rows)), np.int64, n)
            yield first, code, np.array([len(r) for r in rows])
            rows, first, n = [], i + 1, 0


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each unit, the place of its +1 and that of its -1."""
    draw = np.random.default_rng(7).permuted(np.tile(np.arange(DIM), (UNITS, 1)), axis=1)
    return draw[:, 0].copy(), draw[:, 1].copy()


def _count(batches):
    plus, minus = index_vectors()
    units, table = Units(), np.zeros(UNITS * DIM, np.int64)
    for batch in batches:
        for _, code, lengths in chunks(batch.column(0).cast(pa.binary()).to_pylist(), units, COUNT_WORDS):
            row = np.repeat(np.arange(len(lengths)), lengths)
            here = np.flatnonzero(row[1:] == row[:-1])  # pairs of neighbours in one text
            parts = (code & 0xFFFF, code >> 16)
            for a in parts:
                for b in parts:
                    for x, y in ((a[here], b[here + 1]), (a[here + 1], b[here])):
                        table += np.bincount(x * DIM + plus[y], minlength=UNITS * DIM)
                        table -= np.bincount(x * DIM + minus[y], minlength=UNITS * DIM)
    table = table.reshape(UNITS, DIM)
    used = np.flatnonzero(table.any(1))
    for at in range(0, len(used), 4096):
        rows = used[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(table[rows, j], pa.int64()) for j in range(DIM)]], names=["unit", *[f"v{j}" for j in range(DIM)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """UNITS x DIM unit-length vectors from all of docs."""
    columns = [f"v{j}" for j in range(DIM)]
    counted = docs.select("text").mapInArrow(_count, "unit int, " + ", ".join(f"{c} long" for c in columns))
    summed = counted.groupBy("unit").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    table = np.zeros((UNITS, DIM), np.float32)
    for j, c in enumerate(columns):
        table[summed["unit"].to_numpy(), j] = summed[c].to_numpy()
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(texts: list, units: Units, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES a text: mean and spread of its words' vectors and of its shapes', the length of either mean,
    and how alike neighbours are in either; zeros without words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for first, code, lengths in chunks(texts, units, POOL_WORDS):
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        starts = (np.cumsum(lengths) - lengths)[full]
        n = lengths[full, None].astype(np.float32)
        for k, part in enumerate((code & 0xFFFF, code >> 16)):
            v = vectors[part]
            mean = np.add.reduceat(v, starts) / n
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, starts) / n - mean * mean, 0))
            alike = np.zeros(len(v), np.float32)
            alike[1:] = np.einsum("ij,ij->i", v[1:], v[:-1])
            alike[starts] = 0
            out[first + full, 2 * k * DIM : 2 * (k + 1) * DIM] = np.hstack([mean, spread])
            out[first + full, 4 * DIM + 2 * k] = np.linalg.norm(mean, axis=1)
            out[first + full, 4 * DIM + 2 * k + 1] = np.add.reduceat(alike, starts) / n[:, 0]
    return out


class Network:
    """features -> tanh -> logit, standardised inputs, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y[~aside])) == 2
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w1, self.b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.temperature = 1.0
        self._train((x[~aside] - self.mean) / self.scale, y[~aside].astype(float), epochs, rng)
        if len(np.unique(y[aside])) == 2:
            z, t = self.logits(x[aside]), y[aside]
            loss = lambda c: np.logaddexp(0, np.where(t == 1, -z, z) / c).mean()
            self.temperature = min(np.geomspace(0.5, 8, 97), key=loss)

    def _train(self, x, y, epochs, rng, rate=2e-3, decay=1e-4, batch=256):
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                h = np.tanh(x[at] @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[at]) / len(at)
                back = np.outer(d, self.w2) * (1 - h * h)
                grads = [x[at].T @ back + decay * self.w1, back.sum(0), h.T @ d + decay * self.w2, d.sum(keepdims=True)]
                step += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Vectors of all docs, and the network from at most `sample` labelled documents outside the held-out quarter."""
    vectors = word_vectors(docs)
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_ql_y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        units = Units()
        for b in batches:
            x = pooled(b.column("text").cast(pa.binary()).to_pylist(), units, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_ql_y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    # The sample has a bounded number of rows, so its broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").mapInArrow(features, "doc_id long, y int, x binary")
    # One row a doc_id, however often it is repeated: `sample` rows at most reach the driver.
    got = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("doc_id")
    shared.unpersist()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    aside = np.array([zlib.crc32(b"aside:%d" % i) % 6 == 0 for i in got["doc_id"].to_pylist()], bool)
    return vectors, Network(x, got["y"].to_numpy(), aside)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted.

    Only the text is an input of the score. Labels of rows with crc32(doc_id as text) mod 4 = 2 are never read;
    of a document labelled twice the lower label counts, null labels don't. Null and empty texts pool to zeros
    and get that vector's score; without labels of both kinds every score is the labels' mean (0.5 without any).
    Repeated rows get equal scores; an empty table gives an empty result. Input columns named like a result are
    replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    return _scored(docs, *fit(docs, labels, sample))


def _scored(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vectors, vars(network)))
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def scored(batches):
        units, network = Units(), Network.__new__(Network)
        vars(network).update(shared.value[1])
        for b in batches:
            x = pooled(b.column("text").cast(pa.binary()).to_pylist(), units, shared.value[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(network.score(x.astype(float)), pa.float64())], names=[*b.schema.names, "score"])

    out = docs.mapInArrow(scored, schema)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are predicted to be good, columns as in docs; all of them where the labels teach no difference."""
    names = [f"_ql_{i}" for i in range(len(docs.columns))]  # docs may have columns named like a result
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *[c for c in ("doc_id", "text")])
    vectors, network = fit(docs, labels, sample)
    if not network.fitted:
        return docs
    kept = _scored(plain, vectors, network).where("predicted = 1")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
