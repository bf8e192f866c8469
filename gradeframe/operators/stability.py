"""Repeatability of grading: several runs of the same report and rubric.

runs(report_id, item_id, run_id, verdict, score, error)      error <> '' marks a failed run
run_totals(report_id, run_id, total, error)                  total NULL for a failed run
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import as_units, pop_stddev, ratio


def valid_runs(runs: DataFrame) -> DataFrame:
    """Failed runs keep their rows but stay out of every statistic."""
    return runs.where(F.coalesce("error", F.lit("")) == "")


def failed_runs(runs: DataFrame) -> DataFrame:
    """(report_id, error, n): failures listed by kind, so a report that fails often stays one row per kind."""
    return runs.where(F.coalesce("error", F.lit("")) != "").groupBy("report_id", "error").agg(F.count("*").alias("n"))


def verdict_distribution(runs: DataFrame) -> DataFrame:
    """(report_id, item_id, verdict, n)."""
    return valid_runs(runs).groupBy("report_id", "item_id", "verdict").agg(F.count("*").alias("n"))


def item_stability(runs: DataFrame) -> DataFrame:
    """(report_id, item_id, runs, stability): share of the most frequent verdict."""
    return verdict_distribution(runs).groupBy("report_id", "item_id").agg(
        F.sum("n").alias("runs"), ratio(F.max("n"), F.sum("n")).alias("stability"))


def verdict_stability(runs: DataFrame) -> DataFrame:
    """(report_id, items, stability): mean over the items of a report."""
    per_item = item_stability(runs)
    # the shares are summed in item order so that the mean is reproducible to the last bit
    return per_item.groupBy("report_id").agg(
        F.count("*").alias("items"),
        F.array_sort(F.collect_list(F.struct("item_id", "stability"))).alias("shares")).select(
        "report_id", "items", ratio(F.aggregate("shares", F.lit(0.0), lambda a, s: a + s["stability"]),
                                    F.col("items")).alias("stability"))


def score_spread(runs: DataFrame) -> DataFrame:
    """(report_id, item_id, runs, score_range, score_stdev)."""
    s = F.col("score")
    return valid_runs(runs).groupBy("report_id", "item_id").agg(
        F.count(s).alias("runs"), (F.max(s) - F.min(s)).cast("double").alias("score_range"),
        pop_stddev(as_units(s, 100), 100).alias("score_stdev"))


def total_spread(run_totals: DataFrame) -> DataFrame:
    """(report_id, runs, total_range, at_max): counted per distinct total first, so no window over a report."""
    distinct = valid_runs(run_totals).where("total is not null").groupBy("report_id", "total").agg(
        F.count("*").alias("n"))
    return distinct.groupBy("report_id").agg(
        F.sum("n").alias("runs"), (F.max("total") - F.min("total")).cast("double").alias("total_range"),
        F.max_by("n", "total").alias("at_max"))


def quote_rates(quotes: DataFrame) -> DataFrame:
    """(report_id, quote_rate) of quotes with ``matched`` (verbatim in the report); here only the minimum length counts."""
    ok = F.col("matched") & (F.length("quote") >= K.QUOTE_MIN_LEN)
    return quotes.groupBy("report_id").agg(ratio(F.count_if(ok), F.count("*")).alias("quote_rate"))


def stability_gate(run_totals: DataFrame, rates: DataFrame, threshold: float = K.STABILITY_GATE) -> DataFrame:
    """(report_id, valid_rate, quote_rate, passed); ``rates`` come from ``quote_rates`` here or of the evidence chain."""
    runs = run_totals.groupBy("report_id").agg(
        ratio(F.count_if(F.coalesce("error", F.lit("")) == ""), F.count("*")).alias("valid_rate"))
    joined = runs.join(rates, "report_id", "left").withColumn("quote_rate", F.coalesce("quote_rate", F.lit(0.0)))
    return joined.withColumn(
        "passed", (F.col("valid_rate") >= threshold) & (F.col("quote_rate") >= threshold))
