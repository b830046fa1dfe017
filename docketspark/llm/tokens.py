"""Token ids in grammar-compressed blocks (Re-Pair) with random access.

Documents are range-partitioned and sorted by doc_id; each partition is a shard, cut into blocks of about
BLOCK_TOKENS ids, each with a grammar of its own. In a block the frequent pairs of ids are replaced by new symbols,
round after round, until no pair is frequent; the block stores the rules, the length each rule expands to, the remaining symbols and a table of its
documents, so that any document is decoded without the rest. Blocks are rows of a Parquet table, which Spark
commits, prunes and reads in any store.
"""

from __future__ import annotations

import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketspark.llm.common import by_value

by_value(__name__)

END_ID = 1
BLOCK_TOKENS = 1 << 20
#: A pair is replaced in round k if it occurs in one of SHARES[k] places or more, and at least LEAST times; after that as in the last of them.
SHARES, LEAST = (2_000, 8_000, 32_000, 64_000), 12
#: Bytes of text that a task encodes at a time.
PORTION = 16 << 20
MAGIC = b"RPG1"
_HEAD = "<4sIIIIQ"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 18


# --- encoding texts -------------------------------------------------------------------------------------------


def _flags(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _matching(words: pa.Array, some: np.ndarray, pattern: str) -> np.ndarray:
    """Which of the words flagged in some match; the others aren't looked at."""
    out = np.zeros(len(words), bool)
    out[some] = _flags(pc.match_substring_regex(words.filter(pa.array(some)), pattern))
    return out


class WordEncoder:
    """Ids of many texts at once, with every distinct word of theirs encoded once.

    The tokenizer drops white space before it looks for merges and lower-cases, so a text's ids are those of its
    lower-cased words one after another. Letters and the ASCII punctuation after them are pieces of their own, so
    a word's letters and its tail are encoded apart. Many distinct words go into one call; the last id of each
    piece is told by the end mark of its vocabulary entry. Words of ASCII letters need no normalizing, so they
    take the same model behind a plain split at white space.
    """

    #: The pieces that the tokenizer's pre-tokenizer makes: fixed by the tokenizer's file.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    END_MARK, TAIL = "</w>", string.punctuation
    #: Letters that normalizing makes a letter and a combining mark, which is none: fixed by Unicode's composition
    #: exclusions, and the dotted capital I. A word with one is encoded whole.
    SPLIT = "[\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e]"
    AT_ONCE = 512
    #: A tokenizer that gives other ids for these than its words apart is refused.
    PROBE = ["Hello  WORLD, it's 42\n\tÜber-x (a.b)", " lead and trail ", "don't STOP 3.14 \u65e5\u672c \u4e2d", "x", "\u0130, x\u0958-y e\u0301\u0130. I\u0307\u05bc T\u0308"]

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END_MARK)]] = True
        ids, n = self.encode(pa.array(self.PROBE), 0)
        if not np.array_equal(ids, [x for t in self.PROBE for x in [*self.tokenizer.encode(t, add_special_tokens=False).ids, 0]]):
            raise ValueError("the tokenizer does not encode lower-cased words one after another")

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)

    def _together(self, tokenizer, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); one by one if the pieces aren't as many as foreseen."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != pieces.sum() or not pieces.all():
            return self._singly(words)
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, n): the ids of stems[i] are ids[first[i] :][: n[i]]."""
        ascii_letters = _flags(pc.ascii_is_alpha(stems))
        letters = _flags(pc.utf8_is_alpha(stems)) & ~ascii_letters
        letters &= ~_matching(stems, letters, self.SPLIT)
        odd = _flags(pc.not_equal(stems, "")) & ~ascii_letters & ~letters
        pieces = np.ones(len(stems), np.int64)
        normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        normal = [w if w.isascii() else normalize(w) for w in stems.filter(pa.array(odd)).to_pylist()]
        pieces[odd] = pc.count_substring_regex(pa.array(normal, pa.string()), self.PIECES).to_numpy(zero_copy_only=False)
        ids, order, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], np.zeros(len(stems), np.int64)
        for tokenizer, some in ((self.plain, ascii_letters), (self.tokenizer, letters | odd)):
            there = np.flatnonzero(some)
            for at in range(0, len(there), self.AT_ONCE):
                part = there[at : at + self.AT_ONCE]
                got, n[part] = self._together(tokenizer, stems.take(pa.array(part)).to_pylist(), pieces[part])
                ids.append(got)
                order.append(part)
        order, first = np.concatenate(order), np.zeros(len(stems), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids), first, n

    def _distinct(self, words: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table, begins, sizes): the ids of words[i] are table[begins[i] :][: sizes[i]]; behind the words follows end_id."""
        stems = pc.utf8_rtrim(words, characters=self.TAIL)
        letters = _flags(pc.utf8_is_alpha(stems))
        letters &= ~_matching(stems, letters & ~_flags(pc.string_is_ascii(stems)), self.SPLIT)
        apart = pc.or_(pa.array(letters), pc.equal(stems, ""))
        whole = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.where(_flags(apart), pc.binary_length(stems).to_numpy(zero_copy_only=False), whole)
        stems = pc.if_else(apart, stems, words).dictionary_encode()
        tailed = np.flatnonzero(cut < whole)
        some = words.take(pa.array(tailed)).to_pylist()
        tails = pa.array([w[-k:] for w, k in zip(some, (whole - cut)[tailed].tolist(), strict=True)], pa.string()).dictionary_encode()
        ids, first, n = self._stems(stems.dictionary)
        tail_ids, tail_n = self._singly(tails.dictionary.to_pylist())
        table = np.concatenate([ids, tail_ids, [end_id]]).astype(np.uint32)
        stem, tail = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (stems, tails))
        head, rest, rest_first = n[stem], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        rest[tailed], rest_first[tailed] = tail_n[tail], (len(ids) + np.cumsum(tail_n) - tail_n)[tail]
        # Every word is two runs of the table: its stem's ids and its tail's.
        runs = np.append(np.stack([head, rest], 1).ravel(), 1)
        froms = np.append(np.stack([first[stem], rest_first], 1).ravel(), len(table) - 1)
        sizes = np.append(head + rest, 1)
        return gathered(table, froms, runs), np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); every text ends with end_id, a null one is that id alone."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = pc.list_flatten(lists)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = flat.dictionary_encode()
        # A mark may compose with a capital otherwise than with the small letter, so words with one stay as they are.
        small, marked = pc.ascii_lower(words.dictionary), _matching(words.dictionary, ~_flags(pc.string_is_ascii(words.dictionary)), r"\p{M}")
        if marked.any():
            small = pc.if_else(pa.array(marked), words.dictionary, small)
        small = small.dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        code = small.indices.to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, np.int32)
        table, begins, sizes = self._distinct(small.dictionary, end_id)
        # The end of a text is a word of its own, the last in `sizes`.
        code = np.insert(code.astype(np.int64), np.cumsum(per_text), len(sizes) - 1)
        n = sizes[code]
        ends = np.cumsum(n)
        return gathered(table, begins[code], n, ends), np.diff(ends[np.cumsum(per_text + 1) - 1], prepend=0)


# --- Re-Pair blocks -------------------------------------------------------------------------------------------


def _replaced(seq: np.ndarray, at: np.ndarray, rule: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(seq, places of the new symbols) with the pair at each of the places at replaced by symbol top + rule."""
    # Of overlapping places, those at even distance from the start of their run.
    run = np.concatenate(([True], np.diff(at) != 1))
    begin = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
    even = (at - begin) % 2 == 0
    at, rule = at[even], rule[even]
    seq[at] = top + rule
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return seq[keep], at - np.arange(len(at))


def _often(order: np.ndarray, least: int) -> np.ndarray:
    """Values that stand in sorted order `least` times or more."""
    first = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
    return order[first[np.diff(np.append(first, len(order))) >= least]]


def compress(ids: np.ndarray, shares=SHARES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, base): symbol base + i stands for the pair rules[i].

    Rounds of all pairs with a falling threshold, then rounds at the last threshold until no pair reaches it. Those
    look at pairs with a symbol of the round before only: no other pair can have become frequent.
    """
    seq, rules = ids.astype(np.int64), [np.zeros((0, 2), np.int64)]
    base = top = int(seq.max(initial=0)) + 1
    most, new = least, np.zeros(0, np.int64)
    for share in shares:
        if len(seq) < 2:
            break
        keys, most = (seq[:-1] << 32) | seq[1:], max(least, len(seq) // share)
        often = _often(np.sort(keys), most)
        if not len(often):
            continue
        slot = lambda k: ((k.astype(np.uint64) * _MULTIPLY) >> np.uint64(64 - _SLOTS)).astype(np.intp)
        used, one = np.zeros(1 << _SLOTS, bool), np.zeros(1 << _SLOTS, np.int32)
        slots = slot(often)
        used[slots], one[slots] = True, np.arange(len(often))
        slots = slot(keys)
        at = np.flatnonzero(used[slots])
        rule = one[slots[at]].astype(np.int64)
        # Where the slot's pair is another one, the pair may be one of several in that slot, or none.
        other = np.flatnonzero(often[rule] != keys[at])
        rule[other] = np.minimum(np.searchsorted(often, keys[at[other]]), len(often) - 1)
        hit = often[rule] == keys[at]
        seq, new = _replaced(seq, at[hit], rule[hit], top)
        rules.append(np.stack([often >> 32, often & 0xFFFFFFFF], 1))
        top += len(often)
    while len(new):
        at = np.union1d(new[new > 0] - 1, new[new < len(seq) - 1])
        keys = (seq[at] << 32) | seq[at + 1]
        often = _often(np.sort(keys), most)
        if not len(often):
            break
        rule = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        hit = often[rule] == keys
        seq, new = _replaced(seq, at[hit], rule[hit], top)
        rules.append(np.stack([often >> 32, often & 0xFFFFFFFF], 1))
        top += len(often)
    return seq, np.concatenate(rules), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """A rule names symbols of earlier rounds only; so many sums at once as a round has rules."""
    size = np.ones(base + len(rules), np.int64)
    at = 0
    while at < len(rules):
        later = np.flatnonzero(rules[at:].max(1) >= base + at)
        to = at + int(later[0]) if len(later) else len(rules)
        size[base + at : base + to] = size[rules[at:to]].sum(1)
        at = to
    return size[base:]


def gathered(table: np.ndarray, begin: np.ndarray, size: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """table[begin[0] :][: size[0]], table[begin[1] :][: size[1]] and so on, one after another; ends: the sums of size, if known."""
    ends = np.cumsum(size) if ends is None else ends
    return table[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def expansions(rules: np.ndarray, base: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, begin, size): symbol s stands for the ids table[begin[s] :][: size[s]]. All rules of a round at once."""
    size = np.concatenate([np.ones(base, np.int64), lengths])
    begin = np.cumsum(size) - size
    table = np.empty(int(size.sum()), np.uint32)
    table[:base] = np.arange(base, dtype=np.uint32)
    at = 0
    while at < len(rules):
        later = np.flatnonzero(rules[at:].max(1) >= base + at)
        to = at + int(later[0]) if len(later) else len(rules)
        part = rules[at:to].ravel()
        ids = gathered(table, begin[part], size[part])
        table[begin[base + at] : begin[base + at] + len(ids)] = ids
        at = to
    return table, begin, size


def pack_block(doc_ids: list, sizes: list[int], flat: np.ndarray) -> bytes:
    """A self-contained block of documents: their doc_ids (None allowed), numbers of ids, and all ids."""
    seq, rules, base = compress(flat)
    lengths = expansion_lengths(rules, base)
    alphabet, ranks = _ranked(seq, base + len(rules))
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(sizes, "<u4").tobytes()
    head = struct.pack(_HEAD, MAGIC, len(doc_ids), base, len(rules), len(alphabet), len(seq))
    return head + docs + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + alphabet.astype("<u4").tobytes() + ranks.tobytes()


def _ranked(seq: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(top, bool)
    there[seq] = True
    alphabet = np.flatnonzero(there)
    rank = np.zeros(top, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    return alphabet, rank[seq]


class Block:
    """Reads a block; ids() gives all ids, document(i) those of one document alone."""

    def __init__(self, raw: bytes):
        magic, n, self.base, n_rules, n_alphabet, n_seq = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = struct.calcsize(_HEAD)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        doc_ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), null, strict=True)]
        self.sizes = take("<u4", n).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        alphabet = take("<u4", n_alphabet)
        self.seq = alphabet[take("<u2" if n_alphabet <= 1 << 16 else "<u4", n_seq)].astype(np.int64)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        table, begin, size = expansions(self.rules, self.base, self.lengths)
        return gathered(table, begin[seq], size[seq])

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def document(self, i: int) -> np.ndarray:
        """Symbols before and after the document are passed over by their expansion lengths."""
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths])[self.seq]
        ends = np.cumsum(size)
        begin = int(self.sizes[:i].sum())
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, begin + int(self.sizes[i]), "left")
        skip = begin - int(ends[first] - size[first]) if first < len(size) else 0
        return self._expand(self.seq[first : last + 1])[skip : skip + int(self.sizes[i])]


def portions(batches, most: int = PORTION):
    """The batches' rows in slices of about `most` bytes of text."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.searchsorted(upto, np.arange(most, upto[-1] if len(upto) else 0, most), "right")).tolist()
        for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if j > i:
                yield b.slice(i, j - i)


# --- Spark jobs -----------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes docs (doc_id, text) and writes their blocks to path, in ascending order of doc_id.

    Every document ends with end_id; a null or empty text is that id alone. Null doc_ids come first; rows of one
    doc_id go by text. Special tokens are not added. A text longer than a block is a block of its own. An empty
    table writes no blocks.
    """
    spark = docs.sparkSession
    # Half a second to make, so a worker keeps its encoder beside the tokenizer's file for its next tasks.
    shared = spark.sparkContext.broadcast({"json": tokenizer_json})
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        from pyspark import TaskContext

        kept = shared.value
        if "encoder" not in kept:
            kept["encoder"] = WordEncoder(kept["json"])
        encoder = kept["encoder"]
        shard, number, doc_ids, sizes, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            names = ["shard", "block", "n_docs", "n_tokens", "payload"]
            values = [[shard], [number], [len(doc_ids)], [held], [pack_block(doc_ids, sizes, np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for b in portions(batches):
            flat, n = encoder.encode(b.column("text"), end_id)
            for d, size, upto in zip(b.column("doc_id").to_pylist(), n.tolist(), np.cumsum(n).tolist(), strict=True):
                doc_ids.append(d)
                sizes.append(size)
                ids.append(flat[upto - size : upto])
                held += size
                if held >= block_tokens:
                    yield block()
                    number, doc_ids, sizes, ids, held = number + 1, [], [], [], 0
        if doc_ids:
            yield block()

    ordered.mapInArrow(blocks, "shard int, block int, n_docs int, n_tokens long, payload binary").write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, block int, n_docs int, n_tokens long, payload binary").parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block, first: the ids before each block, from sums of shards and then of the blocks in a shard."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("shard", "block", "n_tokens")
    shards = heads.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    return heads.withColumn("inside", inside).join(shards, "shard").select("shard", "block", (F.col("ahead") + F.col("inside")).alias("first"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded blocks of path."""
    blocks = read_blocks(spark, path)

    def decoded(batches):
        kinds = [("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.column("payload")[i].as_py())
                raw, ends = memoryview(block.ids().astype("<u4").tobytes()), np.cumsum(block.sizes)
                starts = ends - block.sizes
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(block.doc_ids)
                cols = [[b.column("shard")[i].as_py()] * n, [b.column("block")[i].as_py()] * n, block.doc_ids, starts, block.sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])

    docs = blocks.select("shard", "block", "payload").mapInArrow(decoded, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    docs = docs.join(block_starts(blocks), ["shard", "block"])
    return docs.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents, without decoding the others."""
    wanted = frozenset(doc_ids)

    def picked(batches):
        for b in batches:
            for raw in b.column("payload").to_pylist():
                block = Block(raw)
                at = [i for i, d in enumerate(block.doc_ids) if d in wanted]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([block.doc_ids[i] for i in at], pa.int64()), pa.array([block.document(i).tolist() for i in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return read_blocks(spark, path).select("payload").mapInArrow(picked, "doc_id long, ids array<long>")
