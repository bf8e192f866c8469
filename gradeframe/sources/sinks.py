"""Sinks: versioned batches, CSV and JSON exports, history bundles, public cases.

Everything is written by the executors as a folder of files; nothing passes through the driver.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.rows import require_clean
from ..operators.redact import check_public

#: A stored check result inside a history entry.
CHECK_RESULT = ("array<struct<name:string,score:double,status:string,"
                "issues:array<struct<problem:string,location:string,impact:string,direction:string>>>>")


def write_batch(details: DataFrame, path: str, batch_id: str, created_at: str, partial: bool = False,
                force_latest: bool = False) -> None:
    """Store one batch under its own folder and then announce it in the pointer table.

    An existing batch is never overwritten. A partial batch is announced too, but does not become the
    latest unless forced; the pointer is written last, so readers never see half a batch.
    """
    details.write.mode("errorifexists").parquet(f"{path}/batches/batch_id={batch_id}")
    spark = details.sparkSession
    pointer = spark.range(0, 1, 1, 1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(created_at).alias("created_at"), F.lit(partial).alias("partial"),
        F.lit(force_latest or not partial).alias("promoted"))
    pointer.write.mode("append").parquet(f"{path}/pointer")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """All stored batches (partition column batch_id, so a filter on it prunes folders)."""
    return spark.read.parquet(f"{path}/batches")


def latest_batch(pointer: DataFrame) -> DataFrame:
    """(batch_id, created_at) of the newest promoted batch."""
    return pointer.where("promoted").agg(F.max(F.struct("created_at", "batch_id")).alias("m")).select(
        "m.batch_id", "m.created_at")


def list_batches(pointer: DataFrame) -> DataFrame:
    """Batches newest first."""
    return pointer.groupBy("batch_id").agg(F.max("created_at").alias("created_at")).orderBy(
        F.desc("created_at"), F.desc("batch_id"))


def csv_safe_column(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(F.left(c, F.lit(1)).isin(*K.CSV_FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(c)


def csv_safe(df: DataFrame) -> DataFrame:
    """All text columns made safe; missing text becomes empty."""
    return df.select(*[
        csv_safe_column(F.coalesce(F.col(f.name), F.lit(""))).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    (csv_safe(df).write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True)
     .csv(path))


def export_class_json(totals: DataFrame, stats: DataFrame, actions: DataFrame, students: DataFrame) -> DataFrame:
    """(class_id, part, line): JSON lines of each class, aggregate, items, actions and one line per student.

    One line per record instead of one document per class: a class of any size is written by many tasks.
    """
    def part(df: DataFrame, name: str) -> DataFrame:
        body = F.struct(*[c for c in df.columns if c != "class_id"])
        return df.select("class_id", F.lit(name).alias("part"),
                         F.to_json(F.struct(F.col("class_id"), F.lit(name).alias("part"), body.alias("data"))).alias("line"))
    return (part(totals, "aggregate").unionByName(part(stats, "item")).unionByName(part(actions, "action"))
            .unionByName(part(students, "student")))


def write_class_json(lines: DataFrame, path: str) -> None:
    """One folder per class. Lines are rebalanced by class first: a class is one file, or one per advisory partition size if it
    is larger, however many tasks made its lines."""
    lines.hint("rebalance", "class_id").select("class_id", "line").write.mode("errorifexists").partitionBy("class_id").text(path)


def export_bundle(history: DataFrame) -> DataFrame:
    """(sid, line): one JSON line per entry in a versioned envelope with the original save time and the whole stored result.

    ``report_id`` and ``items`` (name, score, status and issues of each check) are taken along where the history has them.
    """
    held = set(history.columns)
    items = F.col("items").cast(CHECK_RESULT) if "items" in held else F.array().cast(CHECK_RESULT)
    item = F.struct("name", F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("saved_at"),
                    F.struct((F.col("report_id").cast("string") if "report_id" in held else F.lit("")).alias("report_id"),
                             F.col("total").cast("double").alias("total"), items.alias("items")).alias("result"))
    envelope = F.struct(F.lit("check-history").alias("format"), F.lit(1).alias("version"), "sid", item.alias("item"))
    return history.select("sid", F.to_json(envelope).alias("line"))


def write_bundle(history: DataFrame, path: str) -> None:
    export_bundle(history).select("line").write.mode("errorifexists").text(path)


def write_public_cases(cases: DataFrame, path: str, default_id: str | None = None) -> None:
    """Write the cases to a staging folder, check what was written, then publish it and the manifest of its ids (sorted).

    The gate sees the very rows that would be published. Any problem leaves neither cases nor manifest behind.
    """
    spark, staging = cases.sparkSession, f"{path.rstrip('/')}-staging"
    cases.write.mode("errorifexists").json(staging)
    written = spark.read.schema(cases.schema).json(staging)
    where, done = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, f"{path}/cases"))
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        require_clean(check_public(written), "cases must not be published")
    except ValueError:
        store.delete(where, True)
        raise
    store.mkdirs(done.getParent())
    if store.exists(done) or not store.rename(where, done):
        store.delete(where, True)
        raise ValueError(f"{path}/cases exists already")
    manifest(spark.read.schema("report_id string").json(f"{path}/cases"), default_id).write.mode("errorifexists").json(f"{path}/manifest")


def manifest(cases: DataFrame, default_id: str | None = None) -> DataFrame:
    """Distinct case ids in order, with the default marked."""
    ids = cases.select(F.col("report_id").cast("string").alias("report_id")).distinct().orderBy("report_id")
    return ids.withColumn("is_default", F.lit(False) if default_id is None else F.col("report_id") == default_id)
