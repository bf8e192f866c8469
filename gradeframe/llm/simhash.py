"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprint: lower-cased (A-Z) words, shingles of ``shingle`` words with repeats (fewer words: the whole sequence; none: zero),
XXH64 of each with seed 42 for the first 64 bits and 43, 44, ... for further ones; a bit is set if it is set in over half of
the hashes. Fingerprints link at ``radius`` or fewer differing bits, and documents of linked fingerprints form one component.

Candidates for a small radius: a fingerprint is cut into ``radius + 2`` pieces; two fingerprints within the radius agree on
two pieces at least, so all links are inside the buckets of some pair of pieces. For a radius that is a good part of all bits no such
cut is selective; there, ``tables`` keys of ``key_bits`` bits each are drawn, and a pair at distance d of n bits shares one with
a chance of 1 - (1 - (1 - d / n) ** key_bits) ** tables. A bucket is compared with bit planes: bit k of 64
fingerprints is one machine word, a query's distances to all 64 grow at once in carry-save counters, and a block of 64 is
abandoned as soon as each lane is beyond the radius. Buckets over ``tile`` rows are cut into tiles, which are compared
in pairs by different tasks. Only the edges of a spanning forest leave a task, never all pairs. Of
sampled keys the first few tables are contracted: the others compare all rows, and add edges between components only.

Where ``similarity`` is set, the links are candidates only. The distinct texts (word sequences) of a group of linked fingerprints
meet with their shingle sets, and those of Jaccard similarity ``similarity`` or more are linked, whatever their distance; the
components are those of these links. A group over BLOCK_TEXTS texts or BLOCK_SHINGLES shingles is cut into tiles that meet in pairs.

Edge cases: null and empty texts have fingerprint zero and link like any other; equal fingerprints link whatever the
texts, unless ``similarity`` is set (there, texts without words are one text); repeated rows and repeated or null doc_ids give a row each; extra columns are ignored by ``simhash_components``
and kept by ``simhash_dedup``; an empty table gives an empty result; texts are read whole.
"""

import random
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, spare, staged
from .words import LOWER, buffers, forest, whole_groups

SEED = 42
_TABLE = LOWER.tobytes()


class Likeness(NamedTuple):
    """What a fingerprint is made of, how far two may differ, how candidates meet (tables 0: pairs of pieces, which miss none), and
    the Jaccard similarity of shingles that a link must have (0: the distance alone decides)."""

    shingle: int = 3
    longs: int = 1
    radius: int = 3
    tables: int = 0
    key_bits: int = 0
    similarity: float = 0.0


#: Near copies: Jaccard similarity 0.8 of five-word shingles is an angle of 27 degrees, 19 of 128 bits on average (s.d. 4). The radius
#: is for candidates, nearly three deviations beyond that; the exact similarity decides.
NEAR_COPY = Likeness(shingle=5, longs=2, radius=30, tables=64, key_bits=14, similarity=0.8)
#: Most texts and shingles of a tile in which exact similarities are taken.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Tables of sampled keys whose components are contracted before the other tables are compared.
FIRST_TABLES = 4


def shingled(text: bytes, shingle: int) -> tuple[list[bytes], list[bytes]]:
    """Words and shingles of a text."""
    words = text.translate(_TABLE).split()
    if len(words) < shingle:
        return words, [b" ".join(words)] if words else []
    return words, [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))]


def fingerprint(shingles: list[bytes], longs: int = 1) -> np.ndarray:
    """The bits as unsigned 64-bit integers."""
    if not shingles:
        return np.zeros(longs, np.uint64)
    one, out = xxhash.xxh64_intdigest, []
    for seed in range(SEED, SEED + longs):
        h = np.fromiter((one(s, seed) for s in shingles), np.uint64, len(shingles))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def _names(longs: int) -> list[str]:
    return [f"f{k}" for k in range(longs)]


def fingerprints(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, row (hash of doc_id and text) and f0, f1, ...: the bits as signed longs, one row per document. Where links are to be
    verified also said, the hash of the words, and n_shingles."""
    names = _names(like.longs)

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column("text"))
            fps = np.zeros((len(at) - 1, like.longs), np.uint64)
            said, size = np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int64)
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                words, shingles = shingled(data[a:b].tobytes(), like.shingle)
                fps[k] = fingerprint(shingles, like.longs)
                if like.similarity and words:
                    said[k], size[k] = xxhash.xxh64_intdigest(b" ".join(words), SEED), len(shingles)
            out = {"doc_id": batch.column("doc_id"), "row": batch.column("row")} | {
                c: pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out | ({"said": pa.array(said.view(np.int64)), "n_shingles": pa.array(size)} if like.similarity else {}))

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, row long, " + ", ".join(f"{c} long" for c in names)
    return docs.select("doc_id", row_key(), "text").mapInArrow(run, schema + (", said long, n_shingles long" if like.similarity else ""))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of rows of longs: word w of plane k holds bit k of fingerprints 64 w .. 64 w + 63."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    bits = np.concatenate((bits, np.zeros((-len(bits) % 64, bits.shape[1]), np.uint8)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(plane: np.ndarray, fps: np.ndarray, row: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells (query row, block of 64 lanes): the cells with a lane within the radius, and their lane masks.

    Distances are counted in ``radius.bit_length()`` bit-sliced counters; a carry out of the top one marks a lane as beyond
    for good. After every eighth plane the cells whose lanes are all beyond are abandoned.
    """
    width = radius.bit_length()
    live = np.arange(len(row))
    count = [np.zeros(len(row), np.uint64) for _ in range(width)]
    beyond = np.zeros(len(row), np.uint64)
    for k in range(len(plane)):
        if k % 64 == 0:
            query = fps[row, k // 64]
        carry = plane[k, block] ^ -((query >> np.uint64(k % 64)) & np.uint64(1))
        for j in range(width):
            count[j], carry = count[j] ^ carry, count[j] & carry
        beyond |= carry
        if k % 8 == 7:
            stay = (beyond | _over(count, radius)) != ~np.uint64(0)
            if not stay.all():
                live, row, query, block, beyond = live[stay], row[stay], query[stay], block[stay], beyond[stay]
                count = [c[stay] for c in count]
    mask = ~(beyond | _over(count, radius))
    return live[mask != 0], mask[mask != 0]


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    over, equal = np.zeros(len(count[0]), np.uint64), np.full(len(count[0]), ~np.uint64(0))
    for j in reversed(range(len(count))):
        if radius >> j & 1:
            equal = equal & count[j]
        else:
            over |= equal & count[j]
            equal = equal & ~count[j]
    return over


def bucket_edges(fps: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (pairs of row numbers) among the fingerprints of each bucket; rows are sorted by group.

    side: 0 and 1 are compared with each other only (two tiles of one bucket), 2 with all of the group.
    """
    n = len(fps)
    stop = np.searchsorted(group, group, side="right")
    plane = planes(fps)
    rows = np.arange(n)
    first, last = (rows + 1) >> 6, (stop - 1) >> 6
    todo = np.where(rows + 1 < stop, last - first + 1, 0)
    total = np.concatenate(([0], np.cumsum(todo)))

    def linked():
        for at in range(0, int(total[-1]), cells):
            cell = np.arange(at, min(at + cells, int(total[-1])))
            row = np.searchsorted(total, cell, side="right") - 1
            block = first[row] + cell - total[row]
            hit, mask = within(plane, fps, row, block, radius)
            lane = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, k = np.nonzero(lane)
            a, b = row[hit[which]], block[hit[which]] * 64 + k
            ok = (b > a) & (b < stop[a])
            a, b = a[ok], b[ok]
            ok = (side[a] == 2) | (side[a] != side[b])
            yield a[ok], b[ok]

    root = forest(n, linked())
    moved = np.flatnonzero(root != rows)
    return moved, root[moved]


def merged(edges, most: int = 1 << 20):
    """Edges that connect what batches of edges (a, b) connect; ``most`` of them are gathered before they are handed on."""
    a, b, n = [], [], 0

    def flush():
        ids, place = np.unique(np.concatenate(a + b), return_inverse=True)
        half = len(place) // 2
        root = forest(len(ids), [(place[:half], place[half:])])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"a": pa.array(ids[moved]), "b": pa.array(ids[root[moved]])})

    for x, y in edges:
        apart = x != y
        a.append(x[apart])
        b.append(y[apart])
        n += len(a[-1])
        if n > most:
            yield flush()
            a, b, n = [], [], 0
    if n:
        yield flush()


def _edges_of(longs: int, radius: int):
    names = _names(longs)

    def linked(batches):
        for table in whole_groups(batches, ("part", "key", "tile")):
            fps = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("part", "key", "tile")])
            group = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))
            a, b = bucket_edges(fps, table.column("side").to_numpy(), group, radius)
            label = table.column("label").to_numpy()
            yield label[a], label[b]

    return lambda batches: merged(linked(batches))


def _bucket_keys(like: Likeness) -> list[Column]:
    bits = 64 * like.longs
    if not like.tables:
        if like.longs > 1:
            raise ValueError("pieces are cut from one long; name tables and key_bits for longer fingerprints")
        n = like.radius + 2
        edge = [bits * k // n for k in range(n + 1)]
        piece = [F.shiftrightunsigned("f0", edge[k]).bitwiseAND((1 << (edge[k + 1] - edge[k])) - 1) for k in range(n)]
        return [F.shiftleft(piece[p], edge[q + 1] - edge[q]) + piece[q] for p, q in combinations(range(n), 2)]
    rng, keys = random.Random(bits), []
    for _ in range(like.tables):
        masks = [0] * like.longs
        for bit in rng.sample(range(bits), like.key_bits):
            masks[bit // 64] |= 1 << bit % 64
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys.append(F.xxhash64(*[F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(_names(like.longs), signed)]))
    return keys


def near_edges(fps: DataFrame, like: Likeness = Likeness(), tile: int = 1 << 15, tables: slice = slice(None)) -> DataFrame:
    """Edges (a, b) that connect all distinct rows (id, f0, f1, ...) within the radius (a forest per bucket, merged in each task).

    Rows with a ``label`` are told by it instead of their id: rows of one label are connected already, and buckets that hold one
    label only are left out. ``tables`` chooses among the keys.
    """
    names = _names(like.longs)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), k.alias("key")) for i, k in list(enumerate(_bucket_keys(like)))[tables]])
    label = F.col("label" if "label" in fps.columns else "id").alias("label")
    cells = fps.select(label, *names, F.inline(keys))
    size = cells.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    # Spark sizes cells and buckets by the rows before the keys are dealt out, tens of times too low: neither is to be broadcast
    placed = cells.join(size.select("part", "key", "n").hint("merge"), ["part", "key"]).withColumn("tiles", tiles).withColumn(
        "own", F.pmod(F.xxhash64(*names, F.lit(7)), F.col("tiles")).cast("int"))
    tiled = placed.select("label", *names, "part", "key", "own", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = tiled.select(
        "label", *names, "part", "key", (lo * F.col("tiles").cast("long") + hi).alias("tile"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))
    return dealt.repartition("part", "key", "tile").sortWithinPartitions("part", "key", "tile").mapInArrow(
        _edges_of(like.longs, like.radius), "a long, b long")


def near_roots(fps: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(node, root) of the rows (id, f0, f1, ...) within the radius of others, directly or through others; root is the least id.

    Of sampled keys the first FIRST_TABLES connect most of what is near, and their components are the labels for the others, whose
    buckets then add what connects two components. All rows meet in all tables; a large group makes a few edges a row, not one
    for each table.
    """
    if like.tables <= FIRST_TABLES:
        return components(near_edges(fps, like), "simhash-links")
    for tables in (slice(FIRST_TABLES), slice(FIRST_TABLES, None)):
        roots = components(near_edges(fps, like, tables=tables), "simhash-links").withColumnRenamed("node", "label")
        before = fps if "label" in fps.columns else fps.withColumn("label", F.col("id"))
        after = before.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        fps, _ = staged(after, "simhash-labels")
    return fps.select(F.col("id").alias("node"), F.col("label").alias("root"))


def alike_rows(flat: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row numbers) that connect all sets of Jaccard similarity ``similarity`` or more; set i is flat[at[i]:at[i + 1]].

    A row is compared with all others at once. Rows are taken until those not taken are in one component, so that copies of one
    text need one step.
    """
    size, root, untaken = np.diff(at), np.arange(len(at) - 1), np.ones(len(at) - 1, bool)
    values, column = np.unique(flat, return_inverse=True)
    mark, a, b = np.zeros(len(values), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        left = np.flatnonzero(untaken)
        roots, times = np.unique(root[left], return_counts=True)
        if len(roots) < 2:
            return np.concatenate(a), np.concatenate(b)
        i = left[root[left] != roots[times.argmax()]][0]
        untaken[i] = False
        mark[column[at[i]: at[i + 1]]] = True
        total = np.concatenate(([0], np.cumsum(mark[column])))
        mark[column[at[i]: at[i + 1]]] = False
        shared = total[at[1:]] - total[at[:-1]]
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (size[i] + size - shared) - 1e-9) & (root != root[i]))
        a.append(np.full(len(near), i))
        b.append(near)
        root[np.isin(root, root[near])] = root[i]


def _verified_of(similarity: float):
    def run(batches):
        for table in whole_groups(batches, ("block", "tile")):
            key = np.stack([table.column(c).to_numpy() for c in ("block", "tile")])
            cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            said = table.column("said").to_numpy()
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                sets = table.column("shingles").slice(lo, hi - lo).combine_chunks()
                flat, at = sets.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
                a, b = alike_rows(flat, at, similarity)
                yield pa.RecordBatch.from_pydict({"a": pa.array(said[lo + a]), "b": pa.array(said[lo + b])})

    return run


def _sets_of(shingle: int):
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column("text"))
            sets = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingled(data[a:b].tobytes(), shingle)[1]), np.uint64)).view(np.int64)
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("said", "block", "own", "tiles")} | {
                "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))})

    return run


def verified_edges(docs: DataFrame, fps: DataFrame, blocks: DataFrame, like: Likeness,
                   texts: int = BLOCK_TEXTS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) of ``said`` that connect all texts of one block (id, block) whose shingles are similar enough."""
    nodes = fps.groupBy("said").agg(F.min("row").alias("row"), F.any_value("id").alias("id"), F.max("n_shingles").alias("n_shingles"))
    blocked = nodes.join(blocks, "id", "left").withColumn("block", F.coalesce("block", "id"))
    size = blocked.groupBy("block").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / texts), F.ceil(F.col("total") / shingles)).cast("int")
    wanted, _ = staged(blocked.join(size, "block").withColumn("tiles", tiles).select(
        "row", "said", "block", "tiles", F.pmod(F.xxhash64("said", F.lit(7)), "tiles").cast("int").alias("own")), "near-copy-blocks")
    sets = docs.select(row_key(), "text").join(wanted, "row").select("text", "said", "block", "own", "tiles").mapInArrow(
        _sets_of(like.shingle), "said long, block long, own int, tiles int, shingles array<long>")
    # tiles meet in pairs; the pairs also hold what is inside a tile
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tiles = 1 OR own <> other")
    tile = F.least("own", "other") * F.col("tiles").cast("long") + F.greatest("own", "other")
    return met.select("said", "shingles", "block", tile.alias("tile")).repartition("block", "tile").sortWithinPartitions("block", "tile").mapInArrow(
        _verified_of(like.similarity), "a long, b long")


def _grouped(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, row, the bits, and root and component_id of every document's component."""
    names = _names(like.longs)
    fps, _ = staged(fingerprints(docs, like), "simhash")
    key = F.col("f0") if like.longs == 1 else F.xxhash64(*names)
    fps = fps.withColumn("id", key)
    firsts = fps.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("id", key)
    roots = near_roots(firsts.select("id", *names), like)
    node = "id"
    if like.similarity:
        node, firsts = "said", fps.groupBy("said").agg(F.min("doc_id").alias("first"))
        roots = components(verified_edges(docs, fps, roots.select(F.col("node").alias("id"), F.col("root").alias("block")), like), "near-copy-links")
    rooted = firsts.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "root").select(node, "root", "component_id"), node)


def simhash_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits per long) and component_id, the smallest doc_id of all documents linked directly or not."""
    digits = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in reversed(_names(like.longs))])
    return _grouped(docs, like).select("doc_id", digits.alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, like: Likeness = NEAR_COPY) -> DataFrame:
    """The rows of ``docs`` with one row of each component: of those with the smallest doc_id, the one with the least hash of
    doc_id and text.

    Rows that share a doc_id and differ in their texts are documents of their own. A document without a doc_id counts like any
    other; it stays only where its component has none with a doc_id. Texts are shuffled once, by that hash.
    """
    least = _grouped(docs, like).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least"))
    kept, number = spare(docs, "_kept"), spare(docs, "_number")
    mine = docs.withColumn(kept, row_key())
    keep = least.select(F.col("least.row").alias(kept))
    order = Window.partitionBy(kept).orderBy(kept)
    one = mine.join(keep, kept, "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return one.select(*docs.columns)
