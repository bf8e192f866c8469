"""Rubrics as tables: rubric_items(rubric_id, ord, item_id, name, criteria, max_score, signals...)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import SCORE
from ..functions.rows import literal_table, top_k

RUBRIC_SCHEMA = ("rubric_id string, ord int, item_id string, name string, criteria string, max_score double, "
                 "positive_signals array<string>, negative_signals array<string>")


def default_rubric(spark: SparkSession, rubric_id: str = "default") -> DataFrame:
    """The fixed five items, 100 points together."""
    rows = [(rubric_id, i, item, name, criteria, float(top), list(signals), [])
            for i, (item, name, criteria, top, signals) in enumerate(K.DEFAULT_RUBRIC, 1)]
    return literal_table(spark, RUBRIC_SCHEMA, rows)


def _finite_positive(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c != F.lit(float("inf")))


def validate_rubrics(items: DataFrame, rubrics: DataFrame | None = None) -> DataFrame:
    """Every problem of every rubric: (rubric_id, item_id, problem).

    ``rubrics`` lists the ids that must exist, so that an empty rubric is noticed.
    """
    ident = F.trim(F.coalesce("item_id", F.lit("")))
    per_item = items.groupBy("rubric_id", ident.alias("item_id")).agg(
        F.count("*").alias("n"), F.count_if(~_finite_positive(F.col("max_score").cast("double"))).alias("bad"))
    problems = F.array_compact(F.array(
        F.when(F.col("item_id") == "", "blank_id"),
        F.when((F.col("n") > 1) & (F.col("item_id") != ""), "duplicate_id"),
        F.when(F.col("bad") > 0, "bad_max_score")))
    found = per_item.select("rubric_id", "item_id", F.explode(problems).alias("problem"))
    if rubrics is None:
        return found
    empty = rubrics.select("rubric_id").distinct().join(items.select("rubric_id").distinct(), "rubric_id", "left_anti")
    return found.unionByName(empty.select("rubric_id", F.lit("").alias("item_id"), F.lit("empty").alias("problem")))


def normalize_rubrics(items: DataFrame, normalize: bool = True) -> DataFrame:
    """Cut to 12 items by order first, then scale to 100 at 2 decimals; the residue goes to the first item.

    Adds ``problem``: in strict mode a rubric whose maxima do not add up to 100 is marked, not scaled.
    """
    kept = top_k(items, ["rubric_id"], [F.col("ord")], K.MAX_RUBRIC_ITEMS)
    whole = Window.partitionBy("rubric_id")       # at most 12 rows each after the cut
    total = F.sum(F.col("max_score").cast("decimal(18,6)")).over(whole)
    first = F.col("ord") == F.min("ord").over(whole)
    exact = F.col("max_score").cast("decimal(18,6)")
    if not normalize:
        off = F.abs(total - 100) > F.lit(0.05).cast("decimal(18,6)")
        return kept.withColumn("problem", F.when(off, "total_is_not_100").otherwise("")).withColumn(
            "max_score", exact.cast(SCORE))
    scaled = F.when(F.abs(total - 100) > F.lit("0.000001").cast("decimal(18,6)"),
                    F.bround((exact * 100).cast("decimal(24,6)") / total, 2)).otherwise(exact).cast(SCORE)
    out = kept.withColumn("max_score", scaled)
    residue = (100 - F.sum("max_score").over(whole)).cast(SCORE)
    return out.withColumn("max_score", F.when(first, F.col("max_score") + residue).otherwise(F.col("max_score"))
                          .cast(SCORE)).withColumn("problem", F.lit(""))


def rubric_hash(course: Column, raw_rubric: Column) -> Column:
    """First 16 hex digits over course and rubric text: tells when a result is out of date."""
    return F.left(F.sha2(F.concat(F.coalesce(course, F.lit("")), F.lit("||"), F.coalesce(raw_rubric, F.lit(""))), 256),
                  F.lit(16))


_MATTERS = ["rubric_id", "item_id", "name", "criteria", "max_score", "positive_signals"]


def rubric_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items that differ in a field that affects judging, from either side."""
    a, b = left.select(*_MATTERS), right.select(*_MATTERS)
    return (a.exceptAll(b).withColumn("side", F.lit("left"))
            .unionAll(b.exceptAll(a).withColumn("side", F.lit("right"))))


def stale_results(results: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Results graded under a rubric whose source has changed since."""
    current = rubrics.select("rubric_id", F.col("source_hash").alias("current_hash"))
    return results.join(current, "rubric_id").where("source_hash <> current_hash")
