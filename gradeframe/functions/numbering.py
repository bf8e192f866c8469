"""Numbers and predecessors in the order of any columns, over a whole table or inside its groups, without a window over all of them."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Bits of a row's place inside its range in ``monotonically_increasing_id``.
_INSIDE = 33


def _sorted_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` dealt into sorted ranges, with ``_range`` and ``_place`` (rising with the order over all ranges).

    Ranges come from a sample, so the rows are written to the shared folder: a task that runs again cannot deal them otherwise.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "sorted-ranges")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_place", _INSIDE))


def running_ids(df: DataFrame, *order: str | Column, name: str = "running_id") -> DataFrame:
    """``df`` with ``name`` counting its rows from 1 in the order of the columns ``order``; nulls come first.

    Rows are numbered inside sorted ranges; the rows of all ranges before give the offset. The driver sees one count per range.
    Ids of any type will do, sparse or dense; rows that are equal in ``order`` get neighbouring numbers in no certain order.
    Give narrow rows: whatever ``df`` holds is sorted.
    """
    kept = _sorted_ranges(df, *order)
    before, offsets = 0, []
    for r in sorted(kept.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_range"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    # one row per range of the exchange above
    return kept.join(F.broadcast(table), "_range").withColumn(name, F.col("_before") + inside + 1).drop("_place", "_range", "_before")


def scan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str | None = None,
                previous: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``number`` counting the rows of each group from 1, and for each entry of ``previous`` (new column: column)
    the value in the row before, null in a group's first row.

    A group of any size is many tasks: rows are dealt into ranges sorted by ``keys`` and ``order`` and scanned inside each range;
    only the group that is open where a range begins goes on from the ranges before, so at most one row per range is carried.
    Null keys are a group, null values of ``order`` come first, and rows that are equal in ``keys`` and ``order`` follow each
    other in no certain order (they stay in one range).
    """
    previous = dict(previous or {})
    kept = _sorted_ranges(df, *keys, *order)
    inside = Window.partitionBy("_range", *keys).orderBy("_place")
    scanned = kept.withColumns({"_number": F.row_number().over(inside).cast("long")} | {n: F.lag(c).over(inside) for n, c in previous.items()})
    ends = kept.groupBy("_range", *keys).agg(F.count("*").alias("_n"), *[F.max_by(c, "_place").alias(f"_end_{n}") for n, c in previous.items()])
    along = Window.partitionBy(*keys).orderBy("_range")
    open_ = ends.select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        *[F.lag(f"_end_{n}").over(along).alias(f"_carried_{n}") for n in previous]).where("_before IS NOT NULL")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # a range opens inside one group at most: one row per range
    joined = scanned.join(F.broadcast(open_), same, "left")
    first = F.col("_before").isNotNull() & (F.col("_number") == 1)
    added = {n: F.when(first, F.col(f"_carried_{n}")).otherwise(F.col(n)) for n in previous}
    if number:
        added[number] = F.col("_number") + F.coalesce("_before", F.lit(0))
    return joined.withColumns(added).select(*[c for c in df.columns if c not in added], *added)
