"""Byte-level BPE encoding and decoding from a file of ranks.

Texts are cut into pre-tokens at once for a whole run of texts, by the classes of neighbouring characters (``split``). A pre-token
is resolved in two tiers. A minimal perfect hash over the vocabulary gives the one entry that a pre-token can be, and a
comparison of bytes tells whether it is; that settles most. The others are merged from their bytes up: the bytes are a
linked list, a heap holds the mergeable neighbours by rank and place, and entries that a merge has made stale are passed over.
Results of short pre-tokens stay in a cache of fixed size, so each distinct one is resolved about once per worker.

Decoding looks up the bytes of every id and joins them; no text is needed for it, and ids outside the vocabulary are an error.

The tables grow with the vocabulary only; they are read on the driver and broadcast, so executors need no file.

Edge cases: a null text is the empty text, which has no ids and decodes to no bytes; null and repeated ids of documents are kept row
by row; a text of any length is read whole, and a pre-token of any length is merged in n log n steps; extra columns are
ignored by ``encode_texts`` and kept by ``decode_ids``; an empty table gives an empty result. Short pre-tokens in the cache are
told apart by 64 bits of a hash.
"""

import base64
import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import CHUNK, Texts, buffers, mix

#: Longest pre-token that the cache keeps, its slots, and the ids that it stores before it starts anew.
SHORT, SLOTS, STORE = 64, 1 << 21, 1 << 24
#: Ids decoded at a time (one longer text is decoded at once).
DECODED = 1 << 18
#: Keys to a bucket of the perfect hash.
BUCKET = 4

LETTER, NUMBER, OTHER, SPACE = range(4)
_STEP = np.uint64(0xD1342543DE82EF95)


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point, by the Unicode tables of the tiktoken library's own regex engine."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, single = "".join(map(chr, points)), {bytes([b]): b for b in range(256)}
    kind = np.full(0x110000, OTHER, np.uint8)
    for number, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        kind[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = number
    return kind


def split(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of a run of texts start.

    A pre-token is a run of letters, of numbers or of other marks, with one space before it; or an apostrophe with a contraction;
    or white space: all of it up to the last character before something else, which stands alone unless it is a space.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    size = np.ones(n, np.int64)
    for limit in (0x80, 0x800, 0x10000):
        size += points >= limit
    at = np.cumsum(size) - size
    kind = kinds[points]
    first = np.zeros(n + 3, bool)                                       # first character of a text; three beyond the end stand for one
    first[n:] = True
    first[np.searchsorted(at, offsets[:-1])] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) & ((points[:-1] != 32) | (kind[1:] == SPACE))
    start = new | first[:n]
    start[:-1] |= (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    # contractions: only where the apostrophe starts a pre-token
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[~first[mark + 1]]
    after = points[mark + 1]
    second = np.where(first[mark + 2], 0, points[np.minimum(mark + 2, n - 1)])
    one = np.isin(after, [*b"stmd"])
    two = ((after == ord("r")) | (after == ord("v"))) & (second == ord("e")) | (after == ord("l")) & (second == ord("l"))
    start[mark[one | two] + 1] = False
    rest = np.concatenate((mark[one] + 2, mark[two] + 3))
    start[rest[~first[rest]]] = True
    return at[start]


class Bytes(Texts):
    """A run of texts of which only hashes of spans are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n, self._sums = data, offsets, len(offsets) - 1, None


@dataclass
class PerfectHash:
    """A minimal perfect hash of 64-bit keys: each of n keys has a slot of its own below n.

    A bucket of keys shares a displacement under which its keys fall into free slots; the only key of a bucket names its slot.
    """

    displacement: np.ndarray
    n: int

    @staticmethod
    def _slot(keys: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        return ((mix(keys + d.astype(np.uint64) * _STEP) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return (mix(keys ^ _STEP) % np.uint64(buckets)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys of the perfect hash are not distinct")
        buckets = max(1, n // BUCKET)
        bucket = cls._bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(sizes)
        displacement, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        for size in sorted(set(sizes[sizes > 1].tolist()), reverse=True):
            todo, d = np.flatnonzero(sizes == size), 0
            own = keys[order[ends[todo][:, None] - np.arange(size, 0, -1)]]
            while len(todo):
                # all buckets of a size try a displacement at once; of two that claim a slot the first has it
                slots = cls._slot(own, np.array(d), n)
                fits = ~taken[slots].any(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                _, first = np.unique(slots[fits], return_index=True)
                fits[fits] = np.bincount(first // size, minlength=int(fits.sum())) == size
                displacement[todo[fits]] = d
                taken[slots[fits]] = True
                todo, own, d = todo[~fits], own[~fits], d + 1
        alone = np.flatnonzero(sizes == 1)
        displacement[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]
        return cls(displacement, n)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[self._bucket(keys, len(self.displacement))]
        return np.where(d < 0, -1 - d, self._slot(keys, np.maximum(d, 0), self.n))


@dataclass
class Vocabulary:
    """Tokens by rank: their bytes, the perfect hash over them, and the rank that each mergeable pair of tokens becomes."""

    data: np.ndarray
    offsets: np.ndarray
    perfect: PerfectHash
    by_slot: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    single: np.ndarray
    digest: str = field(default="")

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> "Vocabulary":
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ranks must run from 0 without gaps and hold every single byte")
        data = np.frombuffer(b"".join(tokens), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        keys = Bytes(data, offsets).hashes(offsets[:-1], offsets[1:])
        perfect = PerfectHash.build(keys)
        by_slot = np.zeros(len(tokens), np.int64)
        by_slot[perfect(keys)] = np.arange(len(tokens))
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        return cls(data, offsets, perfect, by_slot, np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64),
                   np.array([ranks[bytes([b])] for b in range(256)]), hashlib.sha256(data.tobytes() + offsets.tobytes()).hexdigest())

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and the number of bytes of each."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.offsets) - 1:
            raise ValueError("an id outside the vocabulary")
        size = np.diff(self.offsets)[ids]
        place = np.cumsum(size) - size
        return self.data[np.repeat(self.offsets[ids] - place, size) + np.arange(int(size.sum()))], size


class Encoder:
    """Ids of whole texts, with a direct-mapped cache of pre-tokens met before."""

    def __init__(self, vocabulary: Vocabulary, slots: int = SLOTS, store: int = STORE):
        self.vocabulary, self.slots, self.store = vocabulary, slots, store
        self.pairs = dict(zip(vocabulary.pair_keys.tolist(), vocabulary.pair_ranks.tolist()))
        self.single = vocabulary.single.tolist()
        self.kinds = character_classes()
        self._clear()

    def _clear(self) -> None:
        self.key, self.at = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.n = np.full(self.slots, -1, np.int32)                      # -1: the slot is free
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the mergeable neighbours of least rank, the leftmost of equals, become one until none is left."""
        pairs, single, push, pop = self.pairs, self.single, heapq.heappush, heapq.heappop
        ids = [single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := pairs.get(rank << 32 | ids[j])) is not None:
                    push(heap, r << 32 | i)
            if (j := before[i]) >= 0 and (r := pairs.get(ids[j] << 32 | rank)) is not None:
                push(heap, r << 32 | j)
        return [t for t in ids if t >= 0]

    def resolve(self, t: Bytes, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after another, and the number of each: the perfect hash first, then the heap."""
        v = self.vocabulary
        token = v.by_slot[v.perfect(key)]
        size, lo = end - start, v.offsets[token]
        same = size == v.offsets[token + 1] - lo
        some = np.flatnonzero(same)
        width = size[some]
        place = np.cumsum(width) - width
        step = np.arange(int(width.sum())) - np.repeat(place, width)
        equal = t.data[np.repeat(start[some], width) + step] == v.data[np.repeat(lo[some], width) + step]
        same[some] = np.add.reduceat(equal, place) == width if len(some) else False
        n = np.ones(len(key), np.int64)
        rest = np.flatnonzero(~same)
        raw = t.data.tobytes()
        merged = [self.merge(raw[a:b]) for a, b in zip(start[rest].tolist(), end[rest].tolist())]
        n[rest] = [len(m) for m in merged]
        out = np.zeros(int(n.sum()), np.int32)
        at = np.cumsum(n) - n
        out[at[same]] = token[same]
        goes = np.ones(len(out), bool)
        goes[at[same]] = False
        out[goes] = [i for m in merged for i in m]
        return out, n

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)))
        self.ids[at: self.used] = ids
        return at

    def __call__(self, t: Bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and the number of ids of each text."""
        if self.used > self.store:
            self._clear()
        start = split(t.data, t.offsets, self.kinds)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(t.n, np.int64)
        end = np.append(start[1:], len(t.data))
        key, short = t.hashes(start, end), end - start <= SHORT
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        known = (self.key[slot] == key) & (n >= 0) & short
        new = np.flatnonzero(~known & short)
        _, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
        new_long = np.flatnonzero(~short)
        where = np.concatenate((new[first], new_long))
        if len(where):
            ids, size = self.resolve(t, start[where], end[where], key[where])
            place = self._keep(ids) + np.cumsum(size) - size
            at[new], n[new] = place[inverse], size[inverse]
            at[new_long], n[new_long] = place[len(first):], size[len(first):]
            into, k = slot[new[first]], len(first)
            self.key[into], self.at[into], self.n[into] = key[new[first]], place[:k], size[:k]
        goes = np.cumsum(n) - n
        out = self.ids[np.repeat(at - goes, n) + np.arange(int(n.sum()))]
        owner = np.searchsorted(t.offsets, start, side="right") - 1
        return out, np.bincount(owner, weights=n, minlength=t.n).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One per Python worker: the cache stays warm from task to task."""
    if vocabulary.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.digest]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank to a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def share_vocabulary(spark: SparkSession, path: str):
    """The vocabulary of a file of ranks, broadcast; its size is that of the file."""
    return spark.sparkContext.broadcast(Vocabulary.of(read_ranks(path)))


def encode_texts(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every document; ``vocabulary`` comes from ``share_vocabulary``."""
    def run(batches):
        encode = encoder(vocabulary.value)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            lo, rows = 0, batch.num_rows
            while lo < rows:
                hi = min(rows, max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1))
                ids, n = encode(Bytes(data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]))
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo),
                                                  "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))})
                lo = hi

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary) -> DataFrame:
    """The table with ``ids`` replaced by ``decoded``, the bytes of the text; null ids decode to null."""
    kept = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        for whole in batches:
            n = np.nan_to_num(whole.column("ids").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            total, lo = np.concatenate(([0], np.cumsum(n))), 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + DECODED, side="right")) - 1)
                batch, lists = whole.slice(lo, hi - lo), whole.column("ids").slice(lo, hi - lo)
                data, size = vocabulary.value.decode(lists.flatten().to_numpy())
                ends = np.concatenate(([0], np.cumsum(size)))[total[lo: hi + 1] - total[lo]]
                valid = pa.array(lists.is_valid().to_numpy(zero_copy_only=False), pa.bool_()).buffers()[1]
                decoded = pa.Array.from_buffers(pa.large_binary(), hi - lo, [valid, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], decoded.cast(pa.binary())], names=[*kept, "decoded"])
                lo = hi

    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return encoded.select(*[f"`{c}`" for c in kept], "ids").mapInArrow(run, f"{fields}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the decoded bytes)."""
    vocabulary = share_vocabulary(docs.sparkSession, path)
    told = encode_texts(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode_ids(told, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
