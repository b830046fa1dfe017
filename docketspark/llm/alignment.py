"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide counts of linked id pairs.

Both tokenizers cut a text's bytes into consecutive tokens. The union of their end offsets cuts it into elementary
intervals; each lies in one token of either side, found by binary search among the ends, so each interval is exactly
one overlap of two tokens and no pair is looked at that doesn't overlap. Ends of both sides close a group.

Documents are aligned in blocks. A block numbers its distinct id pairs, frequent ones first, and keeps of every
document the numbers of its pairs and how often each occurs. Pair counts of all blocks are added by Spark, joined with
the largest count of their id, and come back to each block, which then needs no text any more: every text is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import by_value, stored
from docketspark.llm.tokens import gathered

by_value(__name__)

#: Bytes of text in a block, and of those that are aligned at a time; a longer text is taken whole.
BLOCK_BYTES, PORTION = 16 << 20, 2 << 20
#: Ids of either tokenizer stay below this.
IDS = 1 << 16
MARK = "\u2581"
#: What an encoder must get right before it is used.
PROBE = ["Hello WORLD, it's 42\n\tÜber-x (a.b) don't", "日本 中　٣ 1½\r\n x", "a" * 700 + " <s> </s> <|endoftext|>", "<0x41> \u0085 é \U0001f600 's x\n \ny", " lead  and trail "]


# --- the two tokenizers ---------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others for characters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """Ids of one tokenizer for a space and the text, and the bytes of every id."""

    bytes: list[bytes]

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def checked(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text as 16-bit numbers; none if their bytes don't join to a space and the text."""
        got, raw = self.encode(texts), [b" " + t.encode() for t in texts]
        ids = np.fromiter(chain.from_iterable(got), "<u2")
        upto = np.append(0, np.cumsum(np.array([len(x) for x in got], np.int64)))
        size = np.diff(np.append(0, np.cumsum(self.lengths[ids]))[upto])
        data, at = ids.tobytes(), (2 * upto).tolist()
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if np.array_equal(size, [len(r) for r in raw]) and gathered(self.table, self.begins[ids], self.lengths[ids]).tobytes() == b"".join(raw):
            return out
        return [x if b"".join([self.bytes[i] for i in y]) == r else None for x, y, r in zip(out, got, raw, strict=True)]

    def sized(self) -> None:
        if len(self.bytes) > IDS:
            raise ValueError(f"ids must be below {IDS}")
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.begins, self.table = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.bytes), np.uint8)


class ByteTokenizer(Side):
    """Ids of a byte-level BPE file, whose merges are ranked by id; special tokens' strings are plain text."""

    def __init__(self, tokenizer_json: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary, special = json.loads(tokenizer_json)["model"]["vocab"], {t["content"] for t in json.loads(tokenizer_json)["added_tokens"]}
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.sized()
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_str(tokenizer_json)
        whole.encode_special_tokens = True
        if self.encode(PROBE) != [whole.encode(" " + t, add_special_tokens=False).ids for t in PROBE]:
            raise ValueError("the tokenizer's merges are not ranked by id")

    def encode(self, texts: list[str]) -> list[list[int]]:
        encode = self.encoding.encode_ordinary
        return [encode(" " + t) for t in texts]


class PieceTokenizer(Side):
    """Ids of a piece model, which puts a space before the text. No piece has a space mark behind another character, so no merge goes over the front of a space."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model's pieces go over spaces")
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sized()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Encoder:
    """Both sides' ids of texts, by words where these are apart.

    Where words have single spaces between them and no white space at their ends, either tokenizer cuts a text in
    front of every space, and its ids are those of its words one after another. Distinct words are encoded once.
    """

    #: Words that are kept, about.
    WORDS = 300_000

    def __init__(self, *sides: Side):
        self.sides = sides
        self.known: tuple[dict[str, bytes | None], ...] = tuple({} for _ in sides)
        want = [np.frombuffer(b"".join(s.checked(PROBE)), "<u2") for s in sides]
        if not all(np.array_equal(ids, x) for (ids, _), x in zip(self.encode(pa.array(PROBE)), want, strict=True)):
            raise ValueError("the tokenizers do not encode words one after another")

    def _of_words(self, words: list[str]) -> list[list[bytes | None]]:
        """Each side's ids of the words; none where white space at a word's end could join the next word's."""
        if len(self.known[0]) > self.WORDS:
            self.known = tuple({} for _ in self.sides)
        new = [w for w in words if w not in self.known[0]]
        odd = dict.fromkeys(w for w in new if not w or w[0].isspace() or w[-1].isspace())
        for side, own in zip(self.sides, self.known, strict=True):
            own.update(zip(new, side.checked(new), strict=True))
            own.update(odd)
        return [[own[w] for w in words] for own in self.known]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side all ids and the number of ids of each text; none for null and empty texts and those whose tokens' bytes of a side aren't a space and the text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = pc.list_flatten(lists).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by_word = self._of_words(words.dictionary.to_pylist())
        apart = np.array([None not in x for x in zip(*by_word, strict=True)], bool)
        whole = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False).astype(bool)
        whole[own[~apart[code]]] = True
        some = np.flatnonzero(whole)
        raw = texts.take(pa.array(some)).to_pylist()
        together = list(zip(*[s.checked(raw) for s in self.sides], strict=True)) if raw else []
        # A text that is encoded whole counts as one word more.
        plain = ~whole[own]
        order = np.argsort(np.concatenate((own[plain], some)), kind="stable")
        code = np.concatenate((code[plain], len(apart) + np.arange(len(some))))[order]
        ends = np.cumsum(np.bincount(np.concatenate((own[plain], some)), minlength=len(texts)))
        out = []
        for k, known in enumerate(by_word):
            data = [x or b"" for x in known] + [x[k] if t and None not in x else b"" for t, x in zip(raw, together, strict=True)]
            sizes = np.array([len(x) // 2 for x in data], np.int64)
            n = sizes[code]
            ids = gathered(np.frombuffer(b"".join(data), "<u2").astype(np.int64), (np.cumsum(sizes) - sizes)[code], n)
            out.append((ids, np.diff(np.append(0, np.cumsum(n))[ends], prepend=0)))
        return out


# --- intervals of a portion of texts --------------------------------------------------------------------------


def union_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """union1d of two ascending arrays: a stable sort merges them in linear time."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def _digit_table() -> np.ndarray:
    """Entry 3 * id + k: the id's decimal digits and ',', '|' or ';', padded by zeros to eight bytes."""
    rows = np.zeros((IDS * 3, 8), np.uint8)
    for i in range(IDS):
        for k, end in enumerate(b",|;"):
            s = b"%d%c" % (i, end)
            rows[3 * i + k, : len(s)] = np.frombuffer(s, np.uint8)
    return rows.view(np.uint64).ravel()


class Aligner:
    def __init__(self, tokenizer_json: str, piece_model: bytes):
        self.encoder = Encoder(ByteTokenizer(tokenizer_json), PieceTokenizer(piece_model))
        self.lengths = [s.lengths for s in self.encoder.sides]
        self.digits = _digit_table()
        self.widths = np.count_nonzero(self.digits.view(np.uint8).reshape(-1, 8), axis=1)

    def align(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Arrays by document (n_a, n_b, n_groups, n_links, digest) and by link (pair = a * IDS + b), documents one after another."""
        ids, n = zip(*self.encoder.encode(texts), strict=True)
        end_a, end_b = (np.cumsum(size[x]) for size, x in zip(self.lengths, ids, strict=True))
        ends = union_sorted(end_a, end_b)
        own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        stops_a, stops_b = end_a[own_a] == ends, end_b[own_b] == ends
        shared = stops_a & stops_b
        group = np.cumsum(shared) - shared
        upto = np.searchsorted(ends, np.append(0, end_a)[np.cumsum(n[0])], "right")  # of links, at each document's end
        n_links = np.diff(upto, prepend=0)
        out = {"n_a": n[0], "n_b": n[1], "n_links": n_links, "n_groups": np.diff(np.append(0, np.cumsum(shared))[upto], prepend=0)}
        out["digest"] = self.digests(ids, n, [group[stops_a], group[stops_b]])
        out["pair"] = ids[0][own_a] * IDS + ids[1][own_b]
        return out

    def digests(self, ids, n, groups) -> list[str]:
        """SHA-256 of each document's groups, written a1,a2|b1;a3|b2,b3; groups: of each token of both sides."""
        in_group = [np.bincount(g, minlength=int(g[-1]) + 1 if len(g) else 0) for g in groups]
        at_a = np.arange(len(ids[0])) + (np.cumsum(in_group[1]) - in_group[1])[groups[0]]
        at_b = np.arange(len(ids[1])) + np.cumsum(in_group[0])[groups[1]]
        code = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for at, x, g, end in ((at_a, ids[0], groups[0], 1), (at_b, ids[1], groups[1], 2)):
            last = np.append(g[1:] != g[:-1], True)[: len(g)]
            code[at] = 3 * x + end * last
        flat = self.digits[code].view(np.uint8)
        text = flat[flat != 0].tobytes()
        upto = np.append(0, np.cumsum(self.widths[code]))[np.cumsum(n[0] + n[1])].tolist()
        out, before = [], 0
        for k in upto:
            out.append(hashlib.sha256(memoryview(text)[before : k - 1]).hexdigest() if k > before else "")
            before = k
        return out


# --- blocks of documents --------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest ones first: high ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCK = pa.schema(
    [("block", pa.string()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
    + [("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def block_rows(ids: pa.Array, parts: list[dict]) -> pa.RecordBatch:
    """The rows of a block from the aligned portions of its documents. at: each document's pairs as steps between ascending numbers, times: how often each occurs; pairs, counts: what the numbers stand for and how often the block has it, in the first row."""
    of = {k: np.concatenate([p[k] for p in parts]) for k in ("n_a", "n_b", "n_groups", "n_links")}
    coded = pa.array(np.concatenate([p["pair"] for p in parts])).dictionary_encode()
    code, pairs = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
    counts = np.bincount(code, minlength=len(pairs))
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(pairs), np.int64)
    number[order] = np.arange(len(pairs))
    key = (np.repeat(np.arange(len(ids)), of["n_links"]) << 32) | number[code]
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times, doc, at = np.diff(np.append(new, len(key))), key[new] >> 32, key[new] & 0xFFFFFFFF
    first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    step = np.where(first, at, np.diff(at, prepend=0))
    cut = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    rest = [None] * (len(ids) - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex] * len(ids)), ids, *[pa.array(of[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]]
        + [pa.array([d for p in parts for d in p["digest"]], pa.string())]
        + [pa.array([_planes(x[a:b]) for a, b in spans], pa.binary()) for x in (step, times)]
        + [pa.array([x[order].tolist(), *rest], pa.list_(pa.int64())) for x in (pairs, counts)],
        schema=BLOCK,
    )


def aligned_blocks(docs: DataFrame, tokenizer_json: str, piece_model: bytes) -> DataFrame:
    """A row for each row of docs (doc_id, text), in blocks as of block_rows, stored."""

    def aligned(batches):
        aligner, ids, parts, size = Aligner(tokenizer_json, piece_model), [], [], 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            portion = np.cumsum(lengths) // PORTION
            cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                parts.append(aligner.align(b.column("text")[x:y]))
                ids.append(b.column("doc_id")[x:y])
                size += int(lengths[x:y].sum())
                if size >= BLOCK_BYTES:
                    yield block_rows(pa.concat_arrays(ids), parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield block_rows(pa.concat_arrays(ids), parts)

    schema = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, counts array<long>"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(aligned, schema)
    return stored(rows, "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, n, best: every linked id pair's number of links in the corpus, and whether it is the largest of its b."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    n = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    n = n.select("pair", F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(IDS - 1).alias("b"), "n")
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, tokenizer_json: str, piece_model: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text).

    Side A encodes a space and the text, side B the text, before which its model puts a space. Null and empty texts,
    and texts whose tokens of a side don't join to those bytes, have no tokens: zeros and an empty groups_sha256. A
    link is a pair of token occurrences that overlap; n_best counts links whose id pair no other pair of its B id
    outnumbers in the corpus, count_sum adds up the counts of the links' pairs. Repeated rows are documents each, null
    doc_ids stay, an empty table gives an empty result, other columns don't matter. A text longer than a block is a
    block of its own.
    """
    blocks = aligned_blocks(docs, tokenizer_json, piece_model)
    known = pair_counts(blocks).select("pair", "n", "best")
    own = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("i", "pair"))
    back = own.join(known, "pair").select(F.col("block").alias("own_block"), "i", "n", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        i = right.column("i").to_numpy()
        n[i], best[i] = right.column("n").to_numpy(), right.column("best").to_numpy()
        n_best, count_sum = [], []
        for at, times in zip(left.column("at").to_pylist(), left.column("times").to_pylist(), strict=True):
            at, times = np.cumsum(_numbers(at)), _numbers(times)
            n_best.append(int(best[at] @ times))
            count_sum.append(int(n[at] @ times))
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        kept = kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return kept.append_column("groups_sha256", left.column("groups_sha256"))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    left = blocks.drop("pairs", "counts").groupBy("block")
    return left.cogroup(back.groupBy("own_block")).applyInArrow(summed, schema)
