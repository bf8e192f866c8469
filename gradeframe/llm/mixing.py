"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates r in (0, 2) that meet a source's target, those closest
to "each document once" in (bounded) relative entropy are exponentially tilted by document size: the odds r / (2 - r) equal
exp(lambda * size / mean size). The multiplier of each source is the minimum of a convex dual, found by Newton steps that
are one grouped sum over (source, size) counts each. Rates become whole copies by carrying the words still due from large
documents to small ones, within rounding groups of bounded size.

Edge cases: null and empty texts have size 0, take no words and stay once in the mix; a null source is a source of its own,
last in order; a source without words has target 0; repeated rows (equal id, source and text) share their copies evenly;
extra columns are ignored by ``mix_rates`` and kept by ``mix_documents``; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import spare, staged
from .words import runs

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Rounding groups are about this many documents; a source of any size is dealt over as many as it needs.
GROUP = 8192
#: Newton stops at this relative miss of every target.
TOLERANCE, MAX_STEPS, MAX_STEP = 1e-7, 60, 4.0


def row_key() -> Column:
    """64 bits that name a document row by its id, source and text; only repeated rows share it."""
    return F.xxhash64("doc_id", "source", "text")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, row (see ``row_key``) and size, the number of words of the whole text."""
    kinds = dict(docs.dtypes)

    def count(batches):
        for batch in batches:
            n = [t.n_words for _, _, t in runs(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "source", "row")} | {
                "size": pa.array(np.concatenate(n) if n else np.zeros(0, int), pa.int64())})

    return docs.select("doc_id", "source", row_key().alias("row"), "text").mapInArrow(
        count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, row long, size long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size and target: the share of all words dealt out by weight, capped at ``cap`` times a source's size
    with the excess dealt again until no source is above.

    The table has one row per source; weights follow the order of the names by code point, nulls last. Capped sources are
    fixed in rounds, one grouped sum each, so nothing but two totals reaches the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per, _ = staged(per.withColumn("weight", weight.cast("double")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * float(cap)
    rate, rest = 0.0, share * total
    while True:
        # sources that the last rate fills stay filled: the rate only rises
        full = F.col("weight") * rate >= most
        fixed, free = per.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        higher = (rest - (fixed or 0.0)) / free
        if higher <= rate:
            break
        rate = higher
    return per.select("source", "source_size", F.least(F.col("weight") * rate, most).alias("target"))


def multipliers(sized: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """source and lambda, the tilt of each source, by Newton steps on (source, size) counts.

    A full source (target at the cap) has no finite tilt; its lambda is null, which stands for rate ``cap`` throughout, and a
    source with target 0 gets minus infinity in the same way (rate 0).
    """
    counts, _ = staged(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(cap) * (1 - 1e-12))
    now, _ = staged(targets.where(open_).join(mean, targets.source.eqNullSafe(mean.source), "inner")
                    .select(targets.source, "target", "mean", F.lit(0.0).alias("lambda")), "mix-newton")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lambda") * x, cap)
        slope = rate * (1 - rate / cap) * x
        sums = counts.join(now, counts.source.eqNullSafe(now.source)).groupBy(now.source, "target", "mean", "lambda").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        miss = F.col("got") - F.col("target")
        step = F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), miss / F.greatest("slope", F.col("target") * 1e-6)))
        now, _ = staged(sums.select("source", "target", "mean", (F.col("lambda") - step).alias("lambda"),
                                    (F.abs(miss) / F.col("target")).alias("miss")), "mix-newton")
        worst = now.agg(F.max("miss")).first()[0]
        now = now.drop("miss")
        if worst is None or worst < TOLERANCE:
            break
    return now.select("source", "lambda", "mean")


def _rate(tilt: Column, cap: int) -> Column:
    return cap / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt))))


def round_along(size: np.ndarray, n: np.ndarray, rate: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Copies of n equal rows each: the whole number, at most ``cap`` per row, that brings the words taken so far closest to the
    words due. Sizes descend, so what a long document misses is made up by shorter ones and the last misses are small."""
    total, due = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size)):
        words = max(int(size[i]), 1)
        due += rate[i] * n[i] * words
        total[i] = min(max(round(due / words), 0), cap * n[i])
        due -= total[i] * words
    return total


def mix_rates(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One line per distinct row: doc_id, source, row, size, source_size, target, rate, n (times it occurs) and total, the
    copies of all its occurrences together."""
    sized, _ = staged(sizes(docs), "mix-sizes")
    targets, _ = staged(source_targets(sized, weights, share, cap), "mix-targets")
    tilts = multipliers(sized, targets, cap)
    counted = sized.groupBy("source").agg(F.count("*").alias("_n"))
    s = targets.join(tilts, targets.source.eqNullSafe(tilts.source), "left").select(targets["*"], "lambda", "mean")
    s, _ = staged(s.join(counted, s.source.eqNullSafe(counted.source)).select(
        s.source.alias("_source"), "source_size", "target", "lambda", "mean", F.ceil(F.col("_n") / GROUP).alias("_parts")), "mix-rates")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).when(
        F.col("lambda").isNull(), F.lit(float(cap))).otherwise(_rate(F.col("lambda") * F.col("size") / F.col("mean"), cap))
    rows = sized.groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("n"))
    rated = rows.join(F.broadcast(s) if _few(s) else s, rows.source.eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "row", "size", "source_size", "target", rate.alias("rate"), "n", F.pmod("row", "_parts").alias("_part"))
    kinds = dict(rated.dtypes)

    def take(group):
        group = group.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        group["total"] = round_along(group["size"].to_numpy(), group["n"].to_numpy(), group["rate"].to_numpy(), cap)
        return group.drop(columns="_part")

    out = ", ".join(f"{c} {kinds[c]}" for c in rated.columns if c != "_part")
    return rated.groupBy("source", "_part").applyInPandas(take, f"{out}, total long")


def _few(sources: DataFrame, limit: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast, by counting it."""
    return sources.limit(limit + 1).count() <= limit


def _copies(k: Column) -> Column:
    """Copies of the k-th occurrence: the total dealt out evenly, the first ones getting one more."""
    return F.floor(F.col("total") / F.col("n")) + (k <= F.col("total") % F.col("n")).cast("long")


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes from the document with repeats."""
    each = mix_rates(docs, **options).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.select("doc_id", "size", "source_size", "target", (_copies(F.col("_k")) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as its copies say (0, 1 or 2 times), columns unchanged. Texts are shuffled once."""
    named = mix_rates(docs, **options).where("total > 0").select(F.col("row").alias("_named"), "total", F.col("n").alias("_n"))
    row, k, copy = (spare(docs, c) for c in ("_row", "_k", "_copy"))
    mine = docs.withColumn(row, row_key())
    mine = mine.withColumn(k, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    met = mine.join(named, mine[row] == named["_named"])
    each = F.floor(named["total"] / named["_n"]) + (mine[k] <= named["total"] % named["_n"]).cast("long")
    return met.where(each > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), each))).select(*[mine[c] for c in docs.columns])
