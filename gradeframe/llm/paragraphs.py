"""Repeated passages: paragraph MinHash with exact verification, and content-defined pieces for what stands inside paragraphs.

A paragraph is a line. Its MinHash signature over five-word shingles is cut into BANDS bands of ROWS values, which finds pairs of
Jaccard similarity 0.8 with a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS > 0.999. The distinct paragraphs of a bucket meet in one
task with their shingles, where products of 0/1 matrices give the exact similarity of all of them at once; only the edges of a
spanning forest leave it. Buckets over TILE paragraphs are cut into tiles that are compared in pairs by different tasks.
The forests' components are the classes.

A passage pasted into the middle of different lines is no paragraph. So texts are cut a second time into pieces of REACH + 1
words or more, each beginning where the hash of two words is least among its neighbours up to REACH words away: cuts depend on
the words nearby alone, so two copies of a passage are cut alike but for their edges. Equal pieces form classes as well.

All occurrences but the first of a class are removals. Touching spans of a text are joined, and passages of MIN_PASSAGE words or
more are reported.

Words are lower-cased (A-Z). Edge cases: null and empty texts have no paragraphs; paragraphs under five words only count inside
longer repeats; the first occurrence goes by doc_id (nulls first), then row and place, so ties and repeated rows have one first;
extra columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, staged
from .words import Texts, forest, mix, runs, whole_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 2
#: Most paragraphs of a bucket that one task compares with each other.
TILE = 2048
REACH = 4
MIN_PASSAGE = 20

_FACTOR = 0xA24BAED4963EE407
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _spans(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of word ranges; equal words give equal hashes wherever they stand."""
    n = len(words)
    power = np.full(n + 1, _FACTOR, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    back = np.full(n + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def paragraphs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and text of each line with SHINGLE words or more."""
    start, end, owner = t.lines()
    first, stop = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
    long = stop - first >= SHINGLE
    return first[long], stop[long], owner[long]


def pieces(t: Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and text of each content-defined piece of SHINGLE words or more."""
    n, doc = len(words), t.doc
    top = ~np.uint64(0)
    g = np.full(n, top, np.uint64)
    two, at = t.ngrams(words, 2)
    g[at] = two
    cut = g < top
    for k in range(1, REACH + 1):
        near = doc[k:] == doc[:-k]
        cut[k:] &= ~near | (g[k:] < g[:-k])
        cut[:-k] &= ~near | (g[:-k] <= g[k:])
    cut[t.bounds[:-1][t.n_words > 0]] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], n)[: len(start)]
    long = stop - start >= SHINGLE
    return start[long], stop[long], doc[start[long]]


def units(docs: DataFrame) -> DataFrame:
    """text_no, doc_id, start, stop (words of the text) and unit (hash of the words) of all paragraphs and pieces."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        for batch in batches:
            for lo, hi, t in runs(batch.column("text"), lower=True):
                words = t.word_hashes()
                found = [paragraphs(t), pieces(t, words)]
                first, stop, owner = (np.concatenate(x) for x in zip(*found))
                base = t.bounds[owner]
                yield pa.RecordBatch.from_pydict({
                    "text_no": batch.column("text_no").slice(lo, hi - lo).take(pa.array(owner)), "doc_id": batch.column("doc_id").slice(lo, hi - lo).take(pa.array(owner)),
                    "start": pa.array((first - base).astype(np.int32)), "stop": pa.array((stop - base).astype(np.int32)),
                    "unit": pa.array(_spans(words, first, stop).view(np.int64))})

    return docs.select(F.monotonically_increasing_id().alias("text_no"), "doc_id", "text").mapInArrow(
        cut, f"text_no long, doc_id {kind}, start int, stop int, unit long")


def _shingled(t: Texts):
    """Words' hashes, paragraphs, all shingles inside them and where each paragraph's shingles begin."""
    words = t.word_hashes()
    first, stop, _ = paragraphs(t)
    shingles, at = t.ngrams(words, SHINGLE)
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, stop - SHINGLE, side="right")
    take = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum()))
    return words, first, stop, shingles[take], np.concatenate(([0], np.cumsum(hi - lo)))


def bands(docs: DataFrame) -> DataFrame:
    """unit, band and key: the band keys of every paragraph's MinHash signature."""
    def sign(batches):
        for batch in batches:
            for _, _, t in runs(batch.column("text"), lower=True):
                words, first, stop, shingles, at = _shingled(t)
                if not len(first):
                    continue
                unit = _spans(words, first, stop).view(np.int64)
                _, once = np.unique(unit, return_index=True)
                for b in range(BANDS):
                    key = np.zeros(len(first), np.uint64)
                    for r in range(ROWS):
                        key = mix(key + np.minimum.reduceat(shingles * _SEEDS[b * ROWS + r], at[:-1]))
                    yield pa.RecordBatch.from_pydict({"unit": pa.array(unit[once]), "band": pa.array(np.full(len(once), b, np.int32)),
                                                      "key": pa.array(key[once].view(np.int64))})

    return docs.select("text").mapInArrow(sign, "unit long, band int, key long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """unit and the distinct 32-bit shingles of every paragraph."""
    def gather(batches):
        for batch in batches:
            for _, _, t in runs(batch.column("text"), lower=True):
                words, first, stop, shingles, at = _shingled(t)
                if not len(first):
                    continue
                owner = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(at))
                both = np.unique(owner << np.uint64(32) | shingles >> np.uint64(32))
                ends = np.searchsorted(both >> np.uint64(32), np.arange(len(first) + 1, dtype=np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "unit": pa.array(_spans(words, first, stop).view(np.int64)),
                    "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))})

    return docs.select("text").mapInArrow(gather, "unit long, shingles array<int>")


def similar_rows(flat: np.ndarray, at: np.ndarray, side: np.ndarray, similarity: float, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row numbers) among sets of Jaccard similarity ``similarity`` or more; set i is flat[at[i]:at[i + 1]].

    side: 0 and 1 are compared with each other only, 2 with every row.
    """
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    both = np.zeros((len(size), len(size)), np.float32)
    for lo in range(0, int(shared.sum()), width):
        here = (column >= lo) & (column < lo + width)
        ones = np.zeros((len(size), min(width, int(shared.sum()) - lo)), np.float32)
        ones[owner[here], column[here] - lo] = 1
        both += ones @ ones.T

    def linked():
        for lo in range(0, len(size), 256):
            part = both[lo: lo + 256]
            a, b = np.nonzero(part >= similarity * (size[lo: lo + 256, None] + size - part) - 1e-6)
            a += lo
            ok = (b > a) & ((side[a] == 2) | (side[a] != side[b]))
            yield a[ok], b[ok]

    root = forest(len(size), linked())
    moved = np.flatnonzero(root != np.arange(len(size)))
    return moved, root[moved]


def _links_of(similarity: float):
    def run(batches):
        for table in whole_groups(batches, ("band", "key", "tile")):
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "tile")])
            cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            unit, side, sets = table.column("unit").to_numpy(), table.column("side").to_numpy(), table.column("shingles").combine_chunks()
            flat, at = sets.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if hi - lo > 1:
                    x, y = similar_rows(flat[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], side[lo:hi], similarity)
                    a.append(unit[lo + x])
                    b.append(unit[lo + y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def near_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of spanning forests: they connect, directly or through others, all paragraphs of the similarity that share a
    bucket, and no others."""
    cells = bands(docs).distinct()
    size = cells.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members, _ = staged(cells.join(size, ["band", "key"]), "paragraph-buckets")
    wanted = members.select("unit").distinct()
    sets, _ = staged(shingle_sets(docs).join(wanted, "unit", "left_semi").groupBy("unit").agg(F.any_value("shingles").alias("shingles")), "paragraph-sets")
    placed = members.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("unit", F.lit(7)), F.col("tiles")).cast("int"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = tiled.select(
        "unit", "band", "key", (lo * F.col("tiles").cast("long") + hi).alias("tile"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))
    return dealt.join(sets, "unit").repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile").mapInArrow(
        _links_of(similarity), "a long, b long")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_PASSAGE) -> DataFrame:
    """One row per repeated passage: doc_id, start and stop (words of the text), n_words, class_id (the least class in it) and removed
    (false for first occurrences)."""
    found, _ = staged(units(docs), "passage-units")
    roots, _ = staged(components(near_paragraphs(docs, similarity), "paragraph-links").withColumnRenamed("node", "unit"), "paragraph-classes")
    place = F.struct("doc_id", "text_no", "start")
    per_unit = found.groupBy("unit").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    named = per_unit.join(roots, "unit", "left").select("unit", "n", "first", F.coalesce("root", "unit").alias("class_id"))
    # most units occur once and are near nothing: they need no second grouping
    some, _ = staged(named.where((F.col("n") > 1) | (F.col("class_id") != F.col("unit"))).unionByName(
        named.join(roots.select("root").distinct(), F.col("unit") == F.col("root"), "left_semi").where("n = 1")).distinct(), "passage-classes")
    whole = some.groupBy("class_id").agg(F.sum("n").alias("said"), F.min("first").alias("first")).where("said > 1")
    classes = some.select("unit", "class_id").join(whole, "class_id")
    spans = found.join(classes, "unit").select("text_no", "doc_id", "start", "stop", "class_id", (~place.eqNullSafe(F.col("first"))).alias("removed"))
    along = Window.partitionBy("text_no", "removed").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    island = opened.withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy("text_no", "removed", "island", "doc_id").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("class_id").alias("class_id"))
    return joined.withColumn("n_words", F.col("stop") - F.col("start")).where(F.col("n_words") >= min_words).select(
        "doc_id", "start", "stop", "n_words", "class_id", "removed")
