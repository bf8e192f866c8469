"""Benchmark decontamination: short test items found inside long documents by MinHash containment.

An item is contained in a document if the document has at least ``threshold`` of the item's distinct shingles of five words
(lower case, words parted by ASCII white space). MinHash estimates of Jaccard similarity are blind here, as a document may
have a thousand times an item's shingles; so items are partitioned by size, and each keeps a bottom-k MinHash sketch whose
length fits its partition: with at most u shingles, k = floor((1 - threshold) u) + 1 of them, those that the fewest items
have first and the least hashes among these. A document that lacks at most (1 - threshold) of an item's shingles has one of
any k, so looking up the documents' shingles in the sketches finds every contained item. Rare ones first keep the wording
that many items share out of the sketches, so it makes no candidates unless it is most of an item. Each candidate pair is then
verified by itself: the item's shingles meet that document's, and shared ones are counted exactly. Documents need no sketch,
no hash functions and no windows, and nothing is shuffled but hits and the shingles of candidates that some item has.

All steps are DataFrame functions. Edge cases: null texts and texts without words contain nothing and are contained in
nothing; a text of fewer than five words is one shingle of all its words, so a shorter item is found only as a whole text;
repeated rows of either table count once; items that share an id are told apart by their texts; null ids are kept; extra
columns are ignored by ``contained_items`` and kept by ``decontaminate``; empty tables give empty results. Documents are
read whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .graph import staged

SHINGLE, THRESHOLD = 5, 0.8
_BLANK = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text in lower case; an empty array for null and blank texts."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANK))
    return bind(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def shingles_of(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the n-word windows of a text, in order; of the whole text if it has fewer words."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def windows(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, full).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return bind(hashed, windows)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, h) for all distinct shingles of the items, with ``size``; and the sketch of each: (h, item)."""
    own = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id",
                       F.array_sort(F.array_distinct(shingles_of(F.col("text")))).alias("hs")).where(F.size("hs") > 0).dropDuplicates(["item"])
    own = own.withColumn("size", F.size("hs"))
    # partitions of sizes up to 1, 2, 4, 8, ...; k follows from the largest size of the partition
    most = F.pow(F.lit(2.0), F.ceil(F.log2("size")))
    k = F.least(F.floor((1 - threshold) * most + 1e-9).cast("int") + 1, F.col("size"))
    all_, _ = staged(own.select("item", "item_id", "size", F.explode("hs").alias("h")), "items")
    having = all_.groupBy("h").agg(F.count("*").alias("having"))
    ranked = all_.join(having, "h").groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("having", "h"))).alias("rare"))
    least, _ = staged(ranked.select("item", F.explode(F.slice("rare", F.lit(1), k)["h"]).alias("h")), "item-sketches")
    return all_, least


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, n_shared, n_shingles (of the item), and ``row``, the key of
    the document row (hash of id and text)."""
    all_, least = sketches(items, threshold)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    probes = keyed.select("row", F.explode(F.array_distinct(shingles_of(F.col("text")))).alias("h"))
    found, _ = staged(probes.join(least, "h").select("row", "item").distinct(), "leak-candidates")
    # verification: the shingles of a candidate's item against those of its own document, pair by pair
    texts = keyed.join(found.select("row").distinct(), "row", "left_semi")
    had = texts.select("row", "doc_id", F.explode(F.array_distinct(shingles_of(F.col("text")))).alias("h")).join(
        all_.select("h").distinct(), "h", "left_semi").distinct()
    wanted = found.join(all_, "item")
    shared = wanted.join(had, ["row", "h"]).groupBy("row", "doc_id", "item", "item_id", "size").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= threshold * F.col("size") - 1e-9).select(
        "doc_id", "item_id", "n_shared", F.col("size").cast("long").alias("n_shingles"), "row")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    leaks, _ = staged(contained_items(docs, items, threshold).select(F.col("row").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64("doc_id", "text") == leaks["_leak"], "left_anti")
