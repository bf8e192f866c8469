"""Connected components as joins and groupings, and tables staged in the shared folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared checkpoint folder and read it back: later steps neither repeat the work nor depend
    on shuffle files of executors that may be lost. Returns the table and its path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later result reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has two columns of one ordered type. Each round hangs larger neighbours and then smaller ones on the least
    neighbour (alternating large and small stars), so paths halve and a few rounds suffice; a round is written to the
    shared folder, which keeps plans short. A hub is no problem: minima are combined before the shuffle, and in the
    joins the hub's edges meet one row, which skew splitting deals out. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    x, y = edges.columns
    edges = edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now, path = staged(edges, name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        up = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, done = staged(up.unionByName(least.withColumnRenamed("m", "b")).distinct(), name)
        discard(spark, path)
        path, before, mark = done, mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
