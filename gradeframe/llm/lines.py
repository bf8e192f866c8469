"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised (lower case, ASCII marks and blanks become single spaces); equal normal forms are one distinct line. Each has a
64-bit SimHash of its words: bit j is set if more than half of the words' hashes have it. The 64 counts of a line are kept in 10
longs, seven counters of 9 bits in each, so that a word adds to all of them with 10 additions; lines over 510 words are counted in
their row with 21 bits a counter. Two distinct lines link if their SimHashes differ in RADIUS bits or fewer and the edit similarity of their word sequences
(1 - word edits / words of the longer one) reaches SIMILARITY. Of all lines in one connected group the first stays.

Candidates meet in pigeonhole blocks: a SimHash is cut into RADIUS + 2 pieces, and values within the radius agree on two of
them. A pair of values is a candidate if it is within the radius and the lines' numbers of words are no further apart than the
allowed edits, so lines that are near by chance cost nothing more. Where the block's least value has many candidates (a line
with a thousand variants), these are compared with it alone and not with each other: two lines that both pass with the
common one are in its group anyway. The same holds for one of the lines of a value that has many.
Lines whose test with such a common line failed are compared once more, with all lines near them that have one of their
rare pairs of neighbouring words and are not in their group yet: lines that one frequent word makes near (``the`` in most places)
meet no others for that. No link is lost.

Edge cases: null and empty texts have no lines; lines of marks and blanks alone are never removed and never counted; texts are
ordered by doc_id (nulls first) and lines by number, so ties between equal lines go to the first text; repeated rows are texts
of their own; extra columns are kept by ``dedup_lines`` and otherwise ignored; an empty table gives an empty result. A line may
have up to two million words.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import once
from .graph import components, discard, spare, staged

RADIUS, SIMILARITY, BITS = 3, 0.8, 64
#: A block's head leads the values near it if they are more than FEW and more than one in SHARE of the block: such values are not
#: compared with each other.
FEW, SHARE = 16, 16
#: Lines of one SimHash value that are all compared with those of values near it; of more lines one stands for the value.
SEVERAL = 4
#: Bits of a counter of short and of long lines: 510 and two million words.
LANE, LONG_LANE = 9, 21
#: ASCII characters that are no letter or digit, one by one: a table look-up in the regex engine, which ranges are not.
_MARKS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: One character per word for the edit test; unlike words share one once in 20 480 times.
_ALPHABET = "".join(map(chr, range(0x4E00, 0x4E00 + 20480)))


def line_words(line: Column) -> Column:
    """Words of the normal form in lower case: runs of characters other than ASCII marks, blanks and control characters."""
    return _words(F.lower(line))


def _words(lower: Column) -> Column:
    return F.array_remove(F.split(lower, _MARKS), "")


def _counters(h: Column, width: int) -> list[Column]:
    """What a word adds: counter k counts bits k, k + width, ... below 63 in lanes of ``width`` bits, the last one bit 63."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(_lanes(width)) for k in range(width)] + [F.shiftrightunsigned(h, 63)]


def _majority(counters: list[Column], n: Column, width: int) -> Column:
    """The bits whose count is over half of ``n``: a lane plus what half of n lacks of its top bit carries into that bit."""
    lack = F.lit((1 << width - 1) - 1).cast("long") - F.shiftright(n, 1).cast("long")
    out = F.shiftleft(F.shiftrightunsigned(counters[width] + lack, width - 1), 63)
    for k in range(width):
        over = F.shiftrightunsigned(counters[k] + lack * F.lit(_lanes(width)), width - 1).bitwiseAND(_lanes(width))
        out = out.bitwiseOR(F.shiftleft(over, k))
    return out


def _lanes(width: int) -> int:
    return sum(1 << width * lane for lane in range(63 // width))


def long_simhash(words: Column, width: int = LONG_LANE) -> Column:
    """SimHash of one row's words, without rows of their own."""
    start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(width + 1)])

    def add(sums, h):
        return F.struct(*[(sums[f"c{k}"] + c).alias(f"c{k}") for k, c in enumerate(_counters(h, width))])

    return F.aggregate(F.transform(words, lambda w: F.xxhash64(w)), start, add,
                       lambda sums: _majority([sums[f"c{k}"] for k in range(width + 1)], F.size(words), width))


def symbols(words: Column) -> Column:
    """One character per word, so that string edits are word edits."""
    letters = F.split(F.lit(_ALPHABET), "")
    return F.array_join(F.transform(words, lambda w: F.get(letters, F.pmod(F.xxhash64(w), F.lit(20480)).cast("int"))), "")


def _lines_of(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, pos and words of each line with a word."""
    # the whole text goes to lower case in one call: a line end parts words in any case rule
    lines = docs.select(*columns, F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("pos", "said"))
    return once(lines, "words", _words(F.col("said"))).where(F.size("words") > 0).select(*columns, "pos", "words")


def occurrences(docs: DataFrame) -> DataFrame:
    """text_no, text_key (64-bit hash of the text), doc_id, pos, line (64-bit hash of the normal form), sim and size (words) of every
    line with a word."""
    texts = docs.select(F.monotonically_increasing_id().alias("text_no"), F.xxhash64("text").alias("text_key"), "doc_id", "text")
    # the hash of a line is made before its words become rows, not once for each of them
    hashed = once(_lines_of(texts, "text_no", "text_key", "doc_id"), "line", F.xxhash64("words"))
    # words of a line that small lanes can count become rows; a longer line is one row with its SimHash
    short = F.size("words") <= (1 << LANE) - 2
    # they meet by a number of the line; what else the line has is taken along
    taken = ["text_no", "text_key", "pos", "line", "whole"]
    rows = hashed.withColumn("whole", F.when(~short, long_simhash(F.col("words")))).withColumn("line_no", F.monotonically_increasing_id()).select(
        "line_no", "doc_id", *taken, F.when(short, 1).otherwise(F.size("words")).alias("words"), F.explode_outer(F.when(short, F.col("words"))).alias("word"))
    sums = [F.sum(c).alias(f"c{k}") for k, c in enumerate(_counters(F.xxhash64("word"), LANE))]
    counted = rows.groupBy("line_no", "doc_id").agg(*[F.max(c).alias(c) for c in taken], F.sum("words").alias("n"), *sums)
    sim = F.coalesce("whole", _majority([F.col(f"c{k}") for k in range(LANE + 1)], F.col("n"), LANE))
    return counted.select("text_no", "text_key", "doc_id", "pos", "line", sim.alias("sim"), F.col("n").cast("int").alias("size"))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether lines of so many words can be alike: lengths further apart than the allowed edits settle it. 0 is any number of words."""
    x, y = F.col(a), F.col(b)
    return (x == 0) | (y == 0) | (F.abs(x - y) <= F.floor((1 - similarity) * F.greatest(x, y) + 1e-9))


def near_lines(docs: DataFrame, lines: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of all distinct ``lines`` (line, sim, size, text_key, pos) linked to others, directly or through others; root is the
    least of them. Links are verified on the lines of ``docs``."""
    count = radius + 2
    edge = [BITS * k // count for k in range(count + 1)]
    piece = [F.shiftrightunsigned("sim", edge[k]).bitwiseAND((1 << (edge[k + 1] - edge[k])) - 1) for k in range(count)]
    keys = [F.lit(i << 32).cast("long") + F.shiftleft(piece[p], edge[q + 1] - edge[q]) + piece[q]
            for i, (p, q) in enumerate(combinations(range(count), 2))]
    # blocks of SimHash values: each value once, whatever number of lines has it, with the words of its line if it is one
    values, _ = staged(lines.groupBy("sim").agg(F.when(F.count("*") == 1, F.max("size")).otherwise(0).alias("size")), "line-values")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = values.select("sim", "size", F.explode(F.array(*keys)).alias("key")).repartition(parts, "key")
    block = Window.partitionBy("key")
    headed = cells.select("*", F.min("sim").over(block).alias("head"), F.min_by("size", "sim").over(block).alias("head_size")).where("sim <> head")
    met = headed.select("key", "sim", "size", "head", ((_apart("sim", "head") <= radius) & _possible("size", "head_size", similarity)).alias("met"))
    met = met.select("*", F.sum(F.col("met").cast("int")).over(block).alias("near"), F.count("*").over(block).alias("all"))
    # of a value that is alone with the block's head the head has been the only one to meet
    members, blocks = staged(met.where("met OR all > 1").select(
        "key", "sim", "size", "head", "met", (F.col("met") & (F.col("near") > FEW) & (F.col("near") * SHARE > F.col("all"))).alias("led")), "line-blocks")
    to_head = members.where("met").select(F.col("sim").alias("a"), F.col("head").alias("b"), "led")
    # both sides are the same rows, which Spark shuffles once; so the condition is one that it can't apply to one side
    x, y = (members.select(*[F.col(c).alias(c + n) for c in ("key", "sim", "size", "led")]) for n in "12")
    once_each = F.when(F.col("led2"), ~F.col("led1")).otherwise(~F.col("led1") & (F.col("sim1") < F.col("sim2")))
    rest = x.join(y, F.col("key1") == F.col("key2")).where((_apart("sim1", "sim2") <= radius) & _possible("size1", "size2", similarity) & once_each)
    rest = rest.select(F.greatest("sim1", "sim2").alias("a"), F.least("sim1", "sim2").alias("b"), F.lit(False).alias("led"))
    near, _ = staged(to_head.unionByName(rest).groupBy("a", "b").agg(F.max("led").alias("led")), "near-values")
    discard(lines.sparkSession, blocks)

    # the lines of all values that have a candidate, or more lines than one
    ends = near.select(F.explode(F.array("a", "b")).alias("sim")).unionByName(values.where("size = 0").select("sim")).distinct()
    chosen, _ = staged(lines.join(ends, "sim", "left_semi").select("line", "sim", "size", "text_key", "pos"), "line-chosen")
    # all lines of a value stand for it, or one if they are more than SEVERAL; lines of one value are compared with those that do
    size = chosen.groupBy("sim").agg(F.min("line").alias("least"), (F.count("*") > SEVERAL).alias("many"))
    stands = chosen.join(size, "sim").where(~F.col("many") | (F.col("line") == F.col("least")))
    a, b = (stands.select(F.col("sim").alias(f"v{x}"), F.col("line").alias(x), F.col("size").alias(f"n{x}"), F.col("many").alias(f"many_{x}")) for x in "ab")
    same = chosen.select(F.col("sim").alias("vb"), F.col("line").alias("a"), F.col("size").alias("na")).join(b, "vb").where(
        (F.col("a") > F.col("b")) | F.col("many_b") & (F.col("a") < F.col("b")))
    same = same.select("a", "b", "na", "nb", F.col("vb").alias("va"), "vb", F.when(F.col("many_b"), F.array("vb")).alias("mixed"))
    apart = near.withColumnsRenamed({"a": "va", "b": "vb"}).join(a, "va").join(b, "vb").select(
        "a", "b", "na", "nb", "va", "vb", F.when(F.col("many_a") | F.col("many_b"), F.array("va", "vb")).when(F.col("led"), F.array("va")).alias("mixed"))
    # mixed: the values whose lines meet once more if the test fails, as links through this one were counted on
    pairs, _ = staged(same.unionByName(apart).select("a", "b", "va", "vb", "mixed", _possible("na", "nb", similarity).alias("possible")), "line-pairs")

    # words of the lines that are tested or may be, each from one place where it stands; other lines are not cut into words
    held = pairs.where("possible").select(F.explode(F.array("a", "b")).alias("line")).distinct()
    around = pairs.where("mixed IS NOT NULL").select(F.explode(F.array("va", "vb")).alias("sim")).distinct()
    places = chosen.join(held, "line", "left_semi").select("line", "text_key", "pos").unionByName(
        chosen.join(around, "sim", "left_semi").select("line", "text_key", "pos")).dropDuplicates(["line"])
    wanted = places.select("text_key", F.struct("pos", "line").alias("at")).groupBy("text_key").agg(F.collect_list("at").alias("places"))
    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key").withColumn("said", F.split("text", "\n", -1))
    spelled = keyed.select(F.explode(F.expr("transform(places, p -> struct(p.line AS line, said[p.pos] AS said))")).alias("p")).select("p.*")
    texts, _ = staged(spelled.dropDuplicates(["line"]).select("line", symbols(line_words(F.col("said"))).alias("spelled")), "line-words")

    def verified(candidates: DataFrame) -> DataFrame:
        a = texts.select(F.col("line").alias("a"), F.col("spelled").alias("sa"))
        b = texts.select(F.col("line").alias("b"), F.col("spelled").alias("sb"))
        met = candidates.join(a, "a").join(b, "b").withColumn(
            "allowed", F.floor((1 - similarity) * F.greatest(F.length("sa"), F.length("sb")) + 1e-9).cast("int"))
        # lengths further apart than the allowed edits settle it without the distance; few edits are found in a narrow band
        alike = (F.abs(F.length("sa") - F.length("sb")) <= F.col("allowed")) & (
            (F.expr("levenshtein(sa, sb, least(allowed, 3))") >= 0) | (F.expr("levenshtein(sa, sb, allowed)") >= 0))
        return met.select(*candidates.columns, alike.alias("alike"))

    tested, _ = staged(verified(pairs.where("possible").select("a", "b", "mixed")), "line-tested")
    roots = components(tested.where("alike").select("a", "b"), "line-links")
    # lines of mixed values meet all lines of values near them that share one of their rare word pairs and are not linked with them yet
    failed = pairs.where("NOT possible").select("mixed").unionByName(tested.where("NOT alike").select("mixed"))
    mixed = failed.select(F.explode("mixed").alias("sim")).distinct().withColumn("core", F.lit(True))
    crowd = chosen.select("line", "sim").join(around, "sim", "left_semi").join(mixed, "sim", "left").join(texts, "line").join(
        roots.withColumnRenamed("node", "line"), "line", "left")
    crowd, _ = staged(crowd.select("line", "sim", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("root", "line").alias("label"), "spelled"), "line-crowd")
    rare = rare_pairs(crowd, similarity)
    again, _ = staged(rare.join(rare.select("gram", *[F.col(c).alias(c + "2") for c in ("line", "sim", "core", "label", "size")]), "gram").where(
        "line < line2 AND (core OR core2) AND label <> label2").where((_apart("sim", "sim2") <= radius) & _possible("size", "size2", similarity)).select(
        F.col("line").alias("a"), F.col("line2").alias("b"), F.col("label").alias("la"), F.col("label2").alias("lb")).distinct(), "line-again")
    late = components(verified(again).where("alike").select("la", "lb"), "line-links")
    more = late.select(F.col("node").alias("root"), F.col("root").alias("least"))
    late = late.join(roots.select("node"), "node", "left_anti")
    return roots.join(more, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(late)


def rare_pairs(lines: DataFrame, similarity: float) -> DataFrame:
    """The rarest pairs of neighbouring words (gram, a hash) of each line (line, sim, core, label, spelled): lines alike have one in common.

    Pairs are numbered by how often the line has them, and the first word is a pair with the line's start, so a line of L words has
    L of them. An edit changes two at most. Lines alike are edits <= (1 - similarity) / similarity * L apart, so
    among the 2 * edits + 1 that come first in one order of all pairs both have at least one that the other has, too.
    """
    letters = F.split(F.concat(F.lit("^"), "spelled"), "")
    pairs = F.expr("transform(sequence(1, size(letters) - 1), i -> xxhash64(letters[i - 1], letters[i]))")
    edits = F.floor((1 - similarity) / similarity * F.length("spelled") + 1e-9)
    counted = once(lines.select("line", "spelled"), "letters", letters).select("line", F.explode(pairs).alias("pair")).groupBy("line", "pair").agg(
        F.count("*").alias("times"))
    grams, path = staged(counted.select("line", "pair", F.explode(F.expr("sequence(1L, times)")).alias("nth")).select(
        "line", F.when(F.col("nth") > 1, F.xxhash64("pair", "nth")).otherwise(F.col("pair")).alias("gram")), "line-grams")
    # a pair of words that no other line has links nothing, but it takes its place among the first
    common = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    held = grams.join(common, "gram").join(lines.select("line", "sim", "core", "label", F.length("spelled").alias("size"), (2 * edits + 1 - F.length("spelled")).alias("spare")), "line")
    mine = Window.partitionBy("line")
    held = held.withColumn("place", F.row_number().over(mine.orderBy("n", "gram"))).withColumn("shared", F.count("*").over(mine))
    held, _ = staged(held.where("place <= spare + shared").select("line", "sim", "core", "label", "size", "gram"), "line-rare")
    discard(lines.sparkSession, path)
    return held


def _repeated(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All lines with a word, and text_no, doc_id, pos, group_id and removed of those whose group has a line twice or more lines than one."""
    said, _ = staged(occurrences(docs), "lines")
    place = F.min("text_key").alias("text_key"), F.min_by("pos", "text_key").alias("pos")
    lines, _ = staged(said.groupBy("line").agg(F.max("sim").alias("sim"), F.max("size").alias("size"), F.count("*").alias("n"), *place), "distinct-lines")
    roots = near_lines(docs, lines, radius, similarity)
    linked = roots.select(F.col("node").alias("line"), F.col("root").alias("group_id"))
    alone = lines.where("n > 1").select("line", F.col("line").alias("group_id")).join(linked, "line", "left_anti")
    many, _ = staged(linked.unionByName(alone), "repeated-lines")
    here = F.struct("doc_id", "text_no", "pos")
    again, _ = staged(said.join(many, "line").select("text_no", "doc_id", "pos", "group_id"), "repeated-places")
    first = again.groupBy("group_id").agg(F.min(here).alias("first"))
    return said, again.join(first, "group_id").select("text_no", "doc_id", "pos", "group_id", (~here.eqNullSafe(F.col("first"))).alias("removed"))


def line_groups(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """text_no, doc_id, pos, line, group_id (least line hash of its group) and removed, for every line with a word."""
    said, again = _repeated(docs, radius, similarity)
    return said.join(again.drop("doc_id"), ["text_no", "pos"], "left").select(
        "text_no", "doc_id", "pos", "line", F.coalesce("group_id", "line").alias("group_id"), F.coalesce("removed", F.lit(False)).alias("removed"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """One row per text with a worded line: doc_id, n_lines, n_removed and removed_lines, the numbers of its removed lines."""
    said, again = _repeated(docs, **options)
    gone = again.where("removed").groupBy("text_no").agg(F.count("*").alias("n_removed"), F.array_sort(F.collect_list("pos")).alias("removed_lines"))
    return said.groupBy("text_no", "doc_id").agg(F.count("*").alias("n_lines")).join(gone, "text_no", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts, all columns kept. ``docs`` must be a table (a scan), whose rows are
    numbered alike each time it is read."""
    gone = _repeated(docs, **options)[1].where("removed").groupBy("text_no").agg(F.collect_set("pos").alias("_gone"))
    number = spare(docs, "_no")
    mine = docs.withColumn(number, F.monotonically_increasing_id())
    met = mine.join(gone, mine[number] == gone["text_no"], "left")
    kept = F.filter(F.split(mine["text"], "\n", -1), lambda line, k: ~F.array_contains(gone["_gone"], k))
    text = F.when(gone["_gone"].isNull(), mine["text"]).otherwise(F.array_join(kept, "\n")).alias("text")
    return met.select(*[text if c == "text" else mine[c] for c in docs.columns])
