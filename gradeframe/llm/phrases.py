"""Phrase collocations: contiguous word sequences that occur far more often than their parts would by chance.

Counting comes first, and only what can be frequent is counted as text. Passes over the texts count words, pairs and triples by
hash, a sequence only if its parts are frequent; what reaches the least count enters a bit filter (nothing frequent is ever
missed, a few others slip through). The last pass counts the text of what passes, and of longer sequences all of whose triples
pass; counts are exact, the filters only save work. A filter has at most MAX_BITS: beyond that it lets more through, which
costs time and never a result. Every phrase inside a frequent phrase is frequent, so the counted table holds all parts needed.

Scores need the counts of each phrase's beginnings and ends. The count stream is sorted twice over the cluster, once by words
(a phrase follows its beginnings) and once by words from the last to the first (a phrase follows its ends). Walking down
a sorted stream, the counts of the open beginnings are the last ones seen of each length: no lookup, no hash table, no state but
four numbers. Where a partition starts below an open beginning, its count is one of at most four that the partition lacks;
these few are looked up afterwards. The two streams are then merged in lockstep by phrase.

A phrase is absorbed by a phrase one word longer that contains it and occurs at least ``share`` percent as often; comparing
with one word more is enough, as a longer absorber makes one of those between absorb it too.

Edge cases: a null text is the empty text; a null language is ``und``; repeated rows and repeated ids count each; texts without
words count nothing; extra columns are ignored; an empty table gives an empty result; a text of any length is read whole, and
phrases do not reach across texts, pieces or languages. Ties are broken by count and phrase, so ranks are unique. Words and word
sequences of one task's window are told apart by 64 bits of a hash.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import discard, staged
from .words import CHUNK, LOWER, Texts, buffers, mix

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Words that a task gathers before it hands on their distinct counts, and rows of counts that it merges over its windows.
WINDOW, MERGED = 1 << 20, 1 << 19
MAX_BITS, BITS_PER_ENTRY = 1 << 28, 16
#: Sequences of up to so many words are counted by hash first; each such pass saves the text of what is not frequent.
FILTERED = 3
UNKNOWN = "und"

_BREAK = np.uint8(10)
#: Lower case for A-Z, a line break for every character that ends a piece, a space for a tab.
_TABLE = LOWER.copy()
_TABLE[[*b".,;:!?", 11, 12, 13]], _TABLE[9] = _BREAK, 32
_STEP = np.uint64(0x9FB21C651E98DF25)


class Gathered:
    """Words of many texts: hashes (salted by language), spans of the bytes, language, and whether the next word follows in the same piece."""

    def __init__(self, parts: list[tuple], langs: list[str]):
        sizes = np.cumsum([0] + [len(p[0]) for p in parts])
        self.data = np.concatenate([p[0] for p in parts])
        wide = np.int32 if sizes[-1] < 1 << 31 else np.int64
        self.start, self.end = (np.concatenate([p[k] + wide(base) for p, base in zip(parts, sizes)]) for k in (1, 2))
        self.hash, self.lang, self.follows = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        self.langs = langs

    def longer(self, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n-word sequences from those of n - 1 words, at the places ``at``."""
        return mix(hashes * _STEP + self.hash[at + n - 1])

    def texts(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """The sequences of n words at ``at``, joined by single spaces."""
        first = np.cumsum(n) - n
        word = np.repeat(at - first, n) + np.arange(int(n.sum()))
        size = self.end[word] - self.start[word] + 1                     # with the space after
        place = np.cumsum(size) - size
        total = int(size.sum())
        out = np.full(total, 32, np.uint8)
        byte = np.arange(total) - np.repeat(place, size)
        inside = byte < np.repeat(size - 1, size)
        out[inside] = self.data[(np.repeat(self.start[word], size) + byte)[inside]]
        cut = np.append(place, total)[np.append(first, len(word))]      # each text ends with a space too many
        keep = np.ones(total, bool)
        keep[cut[1:] - 1] = False
        offsets = (cut - np.arange(len(cut))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[keep]))


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def gather(batches, window: int = WINDOW) -> Iterator[Gathered]:
    """Words of whole texts in windows of about ``window`` words (one longer text is a window of its own)."""
    parts, n, langs, number = [], 0, [], {}
    for batch in batches:
        data, at = buffers(batch.column("text"))
        codes = []
        for lang in batch.column("lang").to_pylist():
            if lang not in number:
                number[lang] = len(langs)
                langs.append(lang)
            codes.append(number[lang])
        codes, salts = np.array(codes, np.int32), np.array([_salt(x) for x in langs], np.uint64)
        lo = 0
        while lo < len(codes):
            hi = min(len(codes), max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1))
            t = Texts(_TABLE[data[at[lo]: at[hi]]], at[lo: hi + 1] - at[lo])
            if len(t.start):
                doc = t.doc
                piece = np.cumsum(t.data == _BREAK, dtype=np.int32)[t.start]
                follows = np.zeros(len(doc), bool)
                follows[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
                lang = codes[lo + doc]
                place = np.int32 if len(t.data) < 1 << 31 else np.int64
                parts.append((t.data, t.start.astype(place), t.end.astype(place), mix(t.word_hashes() ^ salts[lang]), lang, follows))
                n += len(doc)
            if n >= window:
                whole, parts, n = Gathered(parts, langs), [], 0         # nothing of a window is held while the next one is gathered
                yield whole
                del whole
            lo = hi
    if parts:
        yield Gathered(parts, langs)


class Passing:
    """A bit filter of hashes in which one 64-bit word holds the four bits of a hash."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1)) if bits is not None else np.uint64(0)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        one, low = np.uint64(1), np.uint64(63)
        mask = np.zeros(len(h), np.uint64)
        for k in range(4):
            mask |= one << (h >> np.uint64(6 * k) & low)
        return self.bits[(h >> self.shift).astype(np.int64)] & mask == mask


def passing(hashes: DataFrame, max_bits: int = MAX_BITS) -> Passing:
    """The filter of a table of hashes ``h``; the driver sees its bits only, which are bounded by ``max_bits``."""
    words = min(max_bits, max(1 << 12, BITS_PER_ENTRY * hashes.count())) // 64
    log = max(1, words.bit_length() - 1)
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {6 * k}) & 63 AS INT))"))
    set_bits = hashes.select(F.shiftrightunsigned("h", 64 - log).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    got = set_bits.toArrow()
    bits = np.zeros(1 << log, np.uint64)
    bits[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Passing(bits)


def _tally(h: np.ndarray) -> Iterator[pa.RecordBatch]:
    each, c = np.unique(h, return_counts=True)
    for lo in range(0, len(each), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_pydict({"h": pa.array(each[part].view(np.int64)), "c": pa.array(c[part])})


def _sequences(g: Gathered, filters: list, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the sequences of 1, 2, ... ``longest`` words; a sequence comes only if both its parts of one word
    less pass the filter of their length (those beyond the last filter: all their parts of that length)."""
    at, h = np.arange(len(g.hash)), g.hash
    for n in range(1, longest + 1):
        if n > 1:
            inside = at + n - 1 < len(g.hash)
            at, h = at[inside], h[inside]
            ok = begins[at + 1] & g.follows[at + n - 2]
            at = at[ok]
            h = g.longer(h[ok], at, n)
        yield at, h
        if n <= len(filters):
            ok = Passing(filters[n - 1])(h)
            at, h = at[ok], h[ok]
        begins = np.zeros(len(g.hash) + 1, bool)                        # where a sequence of n words that counts starts
        begins[at] = True


def merged(batches: Iterator[pa.RecordBatch], most: int = MERGED) -> Iterator[pa.RecordBatch]:
    """The counts of a task's windows summed by their text, so that a phrase comes once for many windows; no more than ``most`` rows
    and one batch are held, and what stays over three quarters of that is handed on."""
    def sums():
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "depth"], use_threads=False).aggregate([("c", "sum")])
        return table.select(["lang", "phrase", "depth", "c_sum"]).rename_columns(["lang", "phrase", "depth", "c"]).to_batches(1 << 13)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            held = sums()
            n = sum(b.num_rows for b in held)
            if 4 * n > 3 * most:
                yield from held
                held, n = [], 0
    if held:
        yield from sums()


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, phrase, depth, c): every sequence of 1 to ``longest`` words that occurs ``least`` times or more in its language,
    and with depth 0 the empty phrase, which counts all words of the language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    filters: list = []

    def hashes(n, shared):
        def count(batches):
            for g in gather(batches):
                for _, h in _sequences(g, [f.value for f in shared], n):
                    pass
                yield from _tally(h)
                del g, h

        return count

    for n in range(1, min(longest, FILTERED) + 1):
        counted = texts.mapInArrow(hashes(n, list(filters)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        frequent, path = staged(counted.where(F.col("c") >= least).select("h"), "phrase-hashes")
        filters.append(spark.sparkContext.broadcast(passing(frequent, max_bits).bits))
        discard(spark, path)

    def phrases(batches):
        bits = [f.value for f in filters]
        for g in gather(batches):
            total = np.bincount(g.lang, minlength=len(g.langs))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(g.langs, pa.string()), "phrase": pa.array([""] * len(g.langs)),
                                              "depth": pa.array(np.zeros(len(g.langs), np.int32)), "c": pa.array(total)})
            for n, (at, h) in enumerate(_sequences(g, bits, longest), 1):
                if n <= len(bits):
                    ok = Passing(bits[n - 1])(h)
                    at, h = at[ok], h[ok]
                _, first, c = np.unique(h, return_index=True, return_counts=True)
                place = at[first]
                for lo in range(0, len(place), 1 << 13):
                    some = place[lo: lo + (1 << 13)]
                    depth = np.full(len(some), n, np.int32)
                    lang = pa.DictionaryArray.from_arrays(pa.array(g.lang[some]), pa.array(g.langs, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": lang, "phrase": g.texts(some, depth), "depth": pa.array(depth),
                                                      "c": pa.array(c[lo: lo + (1 << 13)])})
            del g, at, h, first, c, place

    counted = texts.mapInArrow(lambda batches: merged(phrases(batches)), "lang string, phrase string, depth int, c long")
    return counted.groupBy("lang", "phrase", "depth").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | (F.col("depth") == 0))


def _walk(longest: int):
    def walk(batches):
        last = np.full(longest + 1, -1, np.int64)                       # count of the open phrase of each length; -1: not seen yet
        for batch in batches:
            depth, c = batch.column("depth").to_numpy(), batch.column("c").to_numpy()
            if not len(c):
                continue
            up = np.empty((len(c), longest - 1), np.int64)
            for k in range(1, longest):
                seen = np.maximum.accumulate(np.where(depth == k, np.arange(len(c)), -1))
                up[:, k - 1] = np.where(seen >= 0, c[seen], last[k])
                last[k] = up[-1, k - 1]
            mine = np.arange(1, longest)[None, :] < depth[:, None]
            flat = up[mine]
            offsets = np.concatenate(([0], np.cumsum(depth - 1))).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=flat < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    return walk


def part_counts(counts: DataFrame, ends: bool, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, depth, c, words, parts): counts of the first (``ends``: the last) 1, 2, ... depth - 1 words of each phrase.

    The stream is ranged over the cluster by its words, so a word that starts a third of all phrases is many partitions.
    """
    words = F.split("phrase", " ")
    stream = counts.withColumn("words", F.reverse(words) if ends else words)
    stream = stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").withColumn("range", F.spark_partition_id())
    walked, _ = staged(stream.mapInArrow(_walk(longest), "lang string, phrase string, depth int, c long, words array<string>, range int, parts array<long>"),
                       "phrase-ends" if ends else "phrase-starts")
    # a range lacks the count of at most one phrase of each length; both tables are bounded by longest * ranges rows
    lacks = walked.select("range", "lang", "words", F.posexplode("parts").alias("k", "part")).where("part IS NULL")
    lacks = lacks.groupBy("range", (F.col("k") + 1).alias("k")).agg(F.min(F.struct("lang", "words")).alias("one"))
    lacks = lacks.select("range", "k", F.col("one.lang").alias("lang"), F.expr("slice(one.words, 1, k)").alias("words"))
    found = walked.select("lang", "words", "c").join(F.broadcast(lacks), ["lang", "words"])
    found = found.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("open"))
    filled = walked.join(F.broadcast(found), "range", "left").withColumn("parts", F.expr("transform(parts, (p, i) -> coalesce(p, open[i + 1]))"))
    return filled.select("lang", "phrase", "depth", "c", F.reverse("words").alias("words") if ends else "words", "parts")


def lowest_cut() -> Column:
    """(score, k) of the cut with the lowest score, the first of equals, from the columns c, n, depth, starts and ends.

    Decimals of 38 digits hold products beyond 64 bits, and ``div`` cuts the exact quotient.
    """
    score = ("CAST(1000 AS DECIMAL(4,0)) * CAST(c AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))"
             " div (CAST(starts[k - 1] AS DECIMAL(19,0)) * CAST(ends[depth - k - 1] AS DECIMAL(19,0)))")
    return F.expr(f"array_min(transform(sequence(1, depth - 1), k -> struct({score} AS score, k AS k)))")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE,
                 max_bits: int = MAX_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score (floor of 1000 a n / (l r) at the lowest cut)."""
    counts, _ = staged(phrase_counts(docs, least, longest, max_bits), "phrase-counts")
    totals, counts = counts.where("depth = 0").select("lang", F.col("c").alias("n")), counts.where("depth > 0")
    starts = part_counts(counts, False, longest).where("depth > 1").withColumnRenamed("parts", "starts")
    ends = part_counts(counts, True, longest).where("depth > 1").select("lang", "phrase", F.col("parts").alias("ends"))
    both, _ = staged(starts.hint("merge").join(ends, ["lang", "phrase"]), "phrase-parts")

    longer = both.where("depth > 2")
    absorbed = longer.where(F.expr(f"100 * c >= {share} * starts[depth - 2]")).select("lang", F.expr("array_join(slice(words, 1, depth - 1), ' ')").alias("phrase"))
    absorbed = absorbed.unionByName(longer.where(F.expr(f"100 * c >= {share} * ends[depth - 2]")).select(
        "lang", F.expr("array_join(slice(words, 2, depth - 1), ' ')").alias("phrase"))).distinct()
    kept = both.hint("merge").join(absorbed, ["lang", "phrase"], "left_anti").join(totals, "lang")
    flat = kept.withColumn("cut", lowest_cut()).select(
        "lang", "phrase", F.col("c").alias("a"), F.expr("starts[cut.k - 1]").alias("l"), F.expr("ends[depth - cut.k - 1]").alias("r"), "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
