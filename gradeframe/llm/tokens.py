"""Token ids in a compact binary format: canonical length-limited Huffman codes in independent blocks.

A data set is two Parquet tables below one folder. ``codebook`` holds the code length of every id (codes are canonical, so
lengths are enough). ``blocks`` holds one row per block of whole documents in ascending doc_id order: the documents' ids and
numbers of tokens, the coded bits, and the bit offset of every CHECKPOINT-th token. A block is decoded on its own, from all of
its checkpoints at once, with one table look-up per token. Blocks are numbered inside numbered parts; parts ascend as well.

Edge cases: a null text is the empty text, which has the end id only; rows that repeat a doc_id follow each other in the order
of a hash of their ids; doc_ids are of any ordered type, and null ones come first; a text longer than a block makes a block of its own; extra columns are ignored; an
empty table makes a data set without blocks. An id that never occurs has no code.
"""

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .graph import staged
from .words import Texts, runs

END_ID = 2
#: Longest code in bits; the decoding table has 2 ** LONGEST entries.
LONGEST = 16
#: Tokens of a block (a longer document is one block) and tokens between bit-offset checkpoints.
BLOCK, CHECKPOINT = 1 << 18, 128

_LEAD2, _LEAD34 = np.zeros(256, bool), np.zeros(256, bool)
_LEAD2[0xC3:0xE0], _LEAD34[0xE4:0xF5] = True, True          # first bytes of characters that are surely not white space
_PLAIN, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[0x21:0x7F] = ~np.array([chr(c).isalnum() for c in range(0x21, 0x7F)])


def segments(t: Texts, marks: np.ndarray = _MARK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of pieces that a byte-level tokenizer encodes independently of their neighbours.

    Its pattern always ends a piece before a single space, and around any other single white space character, if the
    characters on both sides are not white space, and between a letter and a mark. Where that is not certain from the bytes
    (letters are those of ASCII and Latin-1) there is no cut, nor before a mark that is not among ``marks``.
    """
    d = t.data
    at = np.flatnonzero(t.space[1:-1]) + 1 if len(d) > 2 else np.zeros(0, np.int64)
    text = np.searchsorted(t.offsets, at, side="right") - 1
    at = at[(at > t.offsets[text]) & (at + 1 < t.offsets[text + 1])]
    before = d[at - 1]
    back = [d[np.maximum(at - k, 0)] for k in (2, 3, 4)]
    tail = (before >= 0x80) & (before < 0xC0) & (_LEAD2[back[0]] | (_LEAD34[back[1]] & (back[1] < 0xF0)) | (back[2] >= 0xF0))
    after = d[at + 1]
    at = at[(_PLAIN[before] | tail) & (_PLAIN[after] | _LEAD2[after] | _LEAD34[after])]
    mark = np.flatnonzero(marks[d])
    mark = mark[mark > 0]
    last, lead = d[mark - 1], d[np.maximum(mark - 2, 0)]
    mark = mark[_LETTER[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]
    cut = np.zeros(len(d) + 1, bool)
    cut[t.offsets[:-1]] = cut[at] = cut[at[d[at] != 32] + 1] = cut[mark] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(d)) if len(start) else start
    return start, end, np.searchsorted(t.offsets, start, side="right") - 1


class Encoder:
    """Ids of whole texts, each distinct segment being tokenized once while it stays in a direct-mapped cache.

    The cache has a fixed number of slots, and its store of ids starts anew when full, so memory is bounded.
    """

    def __init__(self, path: str, end_id: int = END_ID, slots: int = 1 << 21, store: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.slots, self.most = Tokenizer.from_file(path), end_id, slots, store
        self.marks = _MARK.copy()               # without those that stand after a letter inside a special token
        for token in self.tokenizer.get_added_tokens_decoder().values():
            raw = token.content.encode()
            self.marks[[b for a, b in zip(raw, raw[1:]) if _LETTER[a] or a >= 0x80]] = False
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self):
        self.key = np.zeros(self.slots, np.uint64)
        self.at, self.n = np.zeros(self.slots, np.int32), np.full(self.slots, -1, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)))
        self.ids[at: self.used] = ids
        return at

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new segments and the number of each; one call for all, as calls cost more than segments."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        owner = found.word_ids
        if None not in owner:
            return np.array(found.ids, self.dtype), np.bincount(np.array(owner, np.int64), minlength=len(pieces))
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.concatenate([np.array(i, self.dtype) for i in each]), np.fromiter(map(len, each), np.int64, len(each))

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts with an end id after each, and the number of ids of each text."""
        if self.used > self.most:
            self._clear()
        start, end, owner = segments(t, self.marks)
        key = t.hashes(start, end)
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != key) | (n < 0))
        if len(miss):
            fresh, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            raw, where = t.data.tobytes(), miss[first]
            ids, size = self._fresh([raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist())])
            base = self._keep(ids)
            place = base + np.cumsum(size) - size
            at[miss], n[miss] = place[inverse], size[inverse]
            into = slot[where]
            self.key[into], self.at[into], self.n[into] = fresh, place, size
        # each text gets the ids of its segments and the end id
        total = np.bincount(owner, weights=n, minlength=t.n).astype(np.int64) + 1
        out = np.full(int(total.sum()), self.end_id, self.dtype)
        ends = np.cumsum(n) - n + owner                        # of each segment; `owner` end ids stand before
        goes = np.repeat(ends - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[goes] = self.ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return out, total


@lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker: the cache stays warm from task to task."""
    return Encoder(path, end_id)


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian unsigned integers of 2 bytes, or 4 for vocabularies beyond 65 536) of each document."""
    def run(batches):
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            for lo, hi, t in runs(batch.column("text")):
                ids, n = encode(t)
                at = np.concatenate(([0], np.cumsum(n * ids.itemsize))).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": blob})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coin = counts[order].astype(np.float64)
    level, kinds = coin, [np.ones(len(coin), bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((coin, pairs))
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        kinds.append(sort < len(coin))
    take, depth = 2 * len(coin) - 2, np.zeros(len(coin), np.int64)
    for own in reversed(kinds):
        coins = int(own[:take].sum())
        depth[:coins] += 1
        take = 2 * (take - coins)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 0
    # left-aligned to the longest length, each code is the sum of the spaces that the codes before it take
    space = np.left_shift(1, top - size)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(space) - space) >> (top - size)
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For each possible window of ``longest`` bits, the id that it starts with times 256 plus the code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    table = np.zeros(1 << longest, np.uint32)
    filled = np.repeat(order.astype(np.uint32) * 256 + lengths[order], np.left_shift(1, longest - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of a block, most significant first, and the bit offset of every CHECKPOINT-th token."""
    size = lengths[ids].astype(np.uint64)
    stop = np.cumsum(size, dtype=np.uint64)
    start = stop - size
    word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
    left = codes[ids] << (np.uint64(64) - size)
    first = np.flatnonzero(np.diff(word, prepend=-1))             # a code is shorter than a word, so no word is left out
    out = np.zeros(len(first) + 1, np.uint64)
    out[:-1] = np.add.reduceat(left >> shift, first)
    last = np.append(first[1:], len(ids)) - 1
    over = shift[last] > 0
    out[1:][over] |= left[last[over]] << (np.uint64(64) - shift[last[over]])
    return out.astype(">u8").tobytes()[: (int(stop[-1]) + 7) // 8], start[::CHECKPOINT]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The n ids of a block. All stretches between checkpoints are decoded side by side."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, most = checkpoints.astype(np.int64), len(window) - 1
    out = np.zeros((min(CHECKPOINT, n), len(at)), np.uint32)
    for k in range(len(out)):
        bit = at & 7
        hit = table[(window[np.minimum(at >> 3, most)] >> (32 - longest - bit)) & ((1 << longest) - 1)]
        out[k] = hit >> 8
        at += hit & 255
    return out.T.ravel()[:n] if len(out) == CHECKPOINT else out.T.ravel()


def _pieces(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents that make blocks of at most BLOCK tokens, or of one document."""
    total, out, lo = np.concatenate(([0], np.cumsum(n))), [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all documents and write a data set to the new folder ``path``.

    Ids are written once in input order; the counts of all ids (one number per id of the vocabulary) give the code; then the
    ids are dealt by ranges of doc_id and a hash of the ids, sorted and coded, so no text is tokenized twice and the rows of one
    doc_id (or of none) may make many parts. A part is a range; small ranges are put together by their bytes.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    width = Encoder(tokenizer, end_id, slots=1).dtype
    # cut points of ranges are sampled from the keys alone
    ids, _ = staged(encode_texts(docs, tokenizer, end_id).withColumn("tie", F.xxhash64("ids")), "token-ids")

    def tally(batches):
        count = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width))
            count = np.pad(count, (0, max(0, len(seen) - len(count))))
            count[: len(seen)] += seen
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.flatnonzero(count)), "n": pa.array(count[count > 0])})

    counted = ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id)], "lengths binary, end_id int").coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches):
        codes, block = canonical_codes(lengths), 0
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            n = np.fromiter((len(b) // np.dtype(width).itemsize for b in blobs), np.int64, len(blobs))
            for lo, hi in _pieces(n):
                bits, marks = pack(np.frombuffer(b"".join(blobs[lo:hi]), width), lengths, codes)
                yield pa.RecordBatch.from_pydict({
                    "part": batch.column("part").slice(lo, 1), "block": pa.array([block], pa.int32()),
                    "n_tokens": pa.array([int(n[lo:hi].sum())], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo)),
                    "doc_tokens": pa.array([n[lo:hi].tolist()], pa.list_(pa.int64())),
                    "checkpoints": pa.array([marks.astype(np.int64).tolist()], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary())})
                block += 1

    dealt = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(code, f"part int, block int, n_tokens long, doc_ids array<{kind}>, doc_tokens array<long>, checkpoints array<long>, "
                     "bits binary").write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a data set in the order written: part, block, place (in the block), doc_id, start (ids of all documents
    before it), and ids."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = dict(blocks.dtypes)["doc_ids"][len("array<"):-1]

    def decode(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                got = {c: batch.column(c)[row] for c in batch.schema.names}
                ids = unpack(got["bits"].as_py(), got["checkpoints"].values.to_numpy(), got["n_tokens"].as_py(), table).astype("<u4")
                n, docs = got["doc_tokens"].values.to_numpy(), got["doc_ids"].values
                at = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(n), got["part"].as_py(), np.int32)), "block": pa.array(np.full(len(n), got["block"].as_py(), np.int32)),
                    "place": pa.array(np.arange(len(n), dtype=np.int32)), "doc_id": docs, "start": pa.array(at[:-1] + got["before"].as_py()),
                    "ids": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.tobytes())])})

    # starts: totals of parts, then of the blocks of a part; the payload takes no part in it
    of_part = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    of_part = of_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    here = blocks.select("part", "block", "n_tokens").withColumn(
        "here", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens"))
    before = here.join(of_part, "part").select("part", "block", (F.col("here") + F.col("parts_before")).alias("before"))
    return blocks.join(before, ["part", "block"]).mapInArrow(
        decode, f"part int, block int, place int, doc_id {kind}, start long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a data set (to a folder of the shared one unless named), read it back and digest each document:
    doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    read = read_tokens(docs.sparkSession, path)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
