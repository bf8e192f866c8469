"""Class view: item statistics, totals, distribution, student rows, actions and panels.

Inputs, one or many classes at once:
  details(class_id, report_id, pos, item_id, item_name, verdict, score, max_score, confidence,
          needs_review, system_error, ...)      one row per judgement, ``pos`` = place in the report's list, and
          ``report_ord`` = the report's place in its batch where there is one
  results(class_id, report_id, name, total, total_incomplete, coverage, ...)   one row per report
Per-class outputs come from hash aggregates with map-side combine; only already aggregated rows
(a handful of items per class) are ranked in full windows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import mean, ratio
from ..functions.rows import first_row, top_k

_BIN_LABELS = tuple(
    (f"<{hi}" if i == 0 else f"{lo}-{hi}")
    for i, (lo, hi) in enumerate(zip(K.HISTOGRAM_EDGES, K.HISTOGRAM_EDGES[1:])))


#: Room for ``pos`` below a report's place in a packed key.
_POSITIONS = "10000000000000000000"


def place_key(details: DataFrame) -> Column:
    """The place of a judgement in its batch as one comparable value: the report's place (``report_ord``, else its id), then ``pos``.

    Numbers are packed into a decimal, which aggregates keep in fixed-width buffers; only text ids without ``report_ord``
    need a struct.
    """
    report = "report_ord" if "report_ord" in details.columns else "report_id"
    if dict(details.dtypes)[report] in ("tinyint", "smallint", "int", "bigint"):
        return (F.col(report).cast("decimal(19,0)") * F.lit(_POSITIONS).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("pos").cast("decimal(19,0)")
    return F.struct(report, "pos")


def _by_first_sighting(per_name: DataFrame, *figures: Column) -> DataFrame:
    """Rows per (class, item, item_name) with ``seen`` become one row per item, named as first seen, in first-seen order.

    Names are few, so they are ranked after the figures have been aggregated by them.
    """
    item = Window.partitionBy("class_id", "item_id")
    named = per_name.select("class_id", "item_id", "item_name", F.min("seen").over(item).alias("_seen"), *figures,
                            F.row_number().over(item.orderBy("seen", "item_name")).alias("_rank")).where("_rank = 1")
    order = Window.partitionBy("class_id").orderBy("_seen", "item_id")
    return named.withColumn("item_ord", F.row_number().over(order)).drop("_seen", "_rank")


def class_items(details: DataFrame) -> DataFrame:
    """Item dictionary of each class in the order of its batch (class_id, item_id, item_name, item_ord)."""
    name = F.coalesce("item_name", "item_id").alias("item_name")
    seen = details.groupBy("class_id", "item_id", name).agg(F.min(place_key(details)).alias("seen"))
    return _by_first_sighting(seen).select("class_id", "item_id", "item_name", "item_ord")


def first_judgement(details: DataFrame) -> DataFrame:
    """The first judgement of each (report, item) wins."""
    return first_row(details, ["class_id", "report_id", "item_id"], [F.col("pos")])


def countable(details: DataFrame, exclude_recall_miss: bool = False) -> DataFrame:
    """Drop what is not the student's doing: system errors, optionally misses of keyword-recall reports."""
    return details.where(counts_for_student(exclude_recall_miss))


def counts_for_student(exclude_recall_miss: bool = False) -> Column:
    ok = F.coalesce("system_error", F.lit("")) == ""
    if exclude_recall_miss:
        ok = ok & ~((F.col("verdict") == "miss") & (F.col("coverage") == "retrieved"))
    return ok


def class_item_stats(details: DataFrame, exclude_recall_miss: bool = False) -> DataFrame:
    """Counts, ratios and scores per (class, item); items nobody could be counted on stay with zeros."""
    # the first judgement of every (report, item) also holds the first sighting of every item,
    # so dictionary and figures come out of one pass over the details
    ok = counts_for_student(exclude_recall_miss)
    has_max = ok & F.col("max_score").isNotNull()
    scored = F.when(has_max, F.coalesce("score", F.lit(0)))
    place = place_key(details)
    per_name = first_judgement(details).groupBy("class_id", "item_id", F.coalesce("item_name", "item_id").alias("item_name")).agg(
        F.min(place).alias("seen"), F.count_if(ok).alias("counted"), F.count_if(ok & (F.col("verdict") == "hit")).alias("hit"),
        F.count_if(ok & (F.col("verdict") == "partial")).alias("partial"), F.sum(scored).alias("score_sum"), F.count(scored).alias("n_scored"),
        F.sum(F.when(has_max, F.col("max_score"))).alias("max_sum"), F.min(F.when(has_max, place)).alias("max_seen"),
        F.min_by("max_score", F.when(has_max, place)).alias("max_score"), F.count_if(ok & F.col("needs_review")).alias("needs_review"))
    item = Window.partitionBy("class_id", "item_id")
    first_max = F.first("max_score", ignorenulls=True).over(item.orderBy(F.asc_nulls_last("max_seen")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    per_item = _by_first_sighting(
        per_name, first_max.alias("max_score"),
        *[F.sum(c).over(item).alias(c) for c in ("counted", "hit", "partial", "score_sum", "n_scored", "max_sum", "needs_review")]).withColumn(
        "avg_score", ratio(F.col("score_sum"), F.col("n_scored")))
    counted, weak = F.col("counted"), F.col("counted") - F.col("hit")
    miss = weak - F.col("partial")
    return per_item.select(
        "class_id", "item_ord", "item_id", "item_name",
        "counted", "hit", "partial", miss.alias("miss"), weak.alias("weak"),
        F.coalesce(ratio(weak, counted), F.lit(0.0)).alias("weak_ratio"),
        F.coalesce(ratio(miss, counted), F.lit(0.0)).alias("miss_ratio"),
        "avg_score", "max_score", ratio(F.col("score_sum"), F.col("max_sum")).alias("avg_ratio"), "needs_review")


def class_totals(results: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per class; incomplete reports stay out of the score figures, a missing total counts as 0."""
    counted = ~F.coalesce("total_incomplete", F.lit(False))
    total = F.when(counted, F.coalesce("total", F.lit(0)))
    n = F.count(total)
    out = results.groupBy("class_id").agg(
        F.count("*").alias("n_reports"), n.alias("n_scored"), F.count_if(~counted).alias("n_incomplete"),
        F.count_if(F.col("coverage") == "retrieved").alias("n_retrieved"),
        F.coalesce(mean(total), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max(total), F.lit(0)).cast("double").alias("max"),
        F.coalesce(F.min(total), F.lit(0)).cast("double").alias("min"),
        F.coalesce(F.max(total) - F.min(total), F.lit(0)).cast("double").alias("range"),
        F.coalesce(ratio(100 * F.count_if(total >= K.PASS_SCORE), n), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(ratio(100 * F.count_if(total >= K.EXCELLENT_SCORE), n), F.lit(0.0)).alias("excellent_rate"))
    if stats is None:
        return out
    review = stats.groupBy("class_id").agg(F.sum("needs_review").alias("needs_review_total"))
    return out.join(review, "class_id", "left").withColumn(
        "needs_review_total", F.coalesce("needs_review_total", F.lit(0)))


def score_histogram(results: DataFrame) -> DataFrame:
    """Five labelled bins per class, empty bins kept, the top bin open. One aggregate, no label join."""
    counted = ~F.coalesce("total_incomplete", F.lit(False))
    total = F.when(counted, F.coalesce("total", F.lit(0)))
    uppers = K.HISTOGRAM_EDGES[1:]
    bins = []
    for i, label in enumerate(_BIN_LABELS):
        inside = total.isNotNull()
        if i > 0:
            inside = inside & (total >= uppers[i - 1])
        if i < len(uppers) - 1:
            inside = inside & (total < uppers[i])
        bins.append(F.struct(F.lit(i).alias("bin_ord"), F.lit(label).alias("label"),
                             F.count_if(inside).alias("count")))
    return (results.groupBy("class_id").agg(F.array(*bins).alias("bins"))
            .select("class_id", F.inline("bins")))


def student_rows(details: DataFrame, results: DataFrame) -> DataFrame:
    """One row per report: total, flags, review count and the weakest item (lowest share of its maximum)."""
    judged = countable(details)
    weak = F.col("verdict").isin(*K.WEAK_VERDICTS)
    score, top = F.coalesce("score", F.lit(0)), F.col("max_score")
    share = F.try_divide(score.cast("double"), F.greatest(F.coalesce(top, F.lit(1)).cast("double"), F.lit(1e-9)))
    # a report's weak judgements are rubric items at most: a short list costs less than an aggregate that sorts all details
    weakest = F.array_min(F.collect_list(F.when(weak, F.struct(
        share.alias("share"), F.col("pos").alias("pos"),
        F.coalesce("item_name", "item_id").alias("name"),
        (F.coalesce(top, F.lit(0)) - score).cast("double").alias("gap")))))
    per_report = judged.groupBy("class_id", "report_id").agg(
        F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("verdict") == "miss").alias("miss_count"),
        weakest.alias("weakest"))
    return results.join(per_report, ["class_id", "report_id"], "left").select(
        "class_id", "report_id", F.coalesce("name", F.col("report_id").cast("string")).alias("name"), "total",
        F.coalesce("total_incomplete", F.lit(False)).alias("incomplete"), "coverage",
        F.coalesce("needs_review", F.lit(0)).alias("needs_review"),
        F.coalesce("weakest.name", F.lit("")).alias("weakest"),
        F.coalesce("weakest.gap", F.lit(0.0)).alias("weakest_gap"),
        F.coalesce("miss_count", F.lit(0)).alias("miss_count"))


def order_students(students: DataFrame) -> DataFrame:
    """Lowest total first, missing totals last (a distributed range sort)."""
    return students.orderBy("class_id", F.asc_nulls_last("total"), "report_id")


def rank_weak_items(stats: DataFrame) -> DataFrame:
    """Rank of each counted item by weak ratio within its class (a handful of rows per class)."""
    order = Window.partitionBy("class_id").orderBy(F.desc("weak_ratio"), "item_ord")
    return stats.where(F.col("counted") > 0).withColumn("weak_rank", F.row_number().over(order))


def _action(rule_ord: int, kind: str, condition: Column, **values: Column) -> Column:
    """One shape for all four rules, NULL where the rule finds nothing; figures a rule does not use stay NULL."""
    shape = {"item_id": "string", "item_name": "string", "sort_key": "double", "item_ord": "int",
             "counted": "bigint", "hit": "bigint", "weak": "bigint", "miss": "bigint", "weak_ratio": "double",
             "miss_ratio": "double", "avg_score": "double", "max_score": "double", "pending": "bigint"}
    return F.when(condition, F.struct(F.lit(rule_ord).alias("rule_ord"), F.lit(kind).alias("type"), *[
        values.get(c, F.lit(None)).cast(t).alias(c) for c, t in shape.items()]))


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _teaching() -> Column:
    return _action(1, "teaching", (F.col("counted") > 0) & (F.col("weak_ratio") >= K.WEAK_RATIO_ALERT), sort_key=-F.col("weak_ratio"), **_cols(
        "item_id", "item_name", "item_ord", "counted", "weak", "miss", "weak_ratio", "avg_score", "max_score"))


def _brief() -> Column:
    return _action(2, "brief", (F.col("counted") > 0) & (F.col("miss_ratio") >= K.WEAK_RATIO_ALERT), **_cols(
        "item_id", "item_name", "item_ord", "counted", "miss", "miss_ratio"))


def _rubric() -> Column:
    enough = F.greatest(F.lit(3), F.floor(F.col("n_scored") / 2))
    everyone = (F.col("counted") > 0) & (F.col("hit") == F.col("counted")) & (F.col("counted") >= enough)
    return _action(3, "rubric", everyone, **_cols("item_id", "item_name", "item_ord", "counted", "hit"))


def _review() -> Column:
    return _action(4, "review", F.col("needs_review_total") > 0, pending=F.col("needs_review_total"))


def _found(df: DataFrame, *rules: Column) -> DataFrame:
    """The actions that the rules find in each row, from one pass over ``df``."""
    return df.select("class_id", F.inline(F.array_compact(F.array(*rules))))


def actions_teaching(stats: DataFrame) -> DataFrame:
    """Items at least half of the class did not fully get, worst first."""
    return _found(stats, _teaching())


def actions_brief(stats: DataFrame) -> DataFrame:
    """Items at least half of the class left out entirely."""
    return _found(stats, _brief())


def actions_rubric(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Items everyone got in full: no power to tell reports apart."""
    return _found(stats.join(totals.select("class_id", "n_scored"), "class_id"), _rubric())


def actions_review(totals: DataFrame) -> DataFrame:
    """Judgements still waiting for a human."""
    return _found(totals, _review())


def class_actions(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """All four rules for classes with scored reports; order by (class_id, rule_ord, sort_key, item_ord).

    ``totals`` with ``needs_review_total`` says how many judgements wait; without that column they are summed from ``stats``,
    which are then computed once for everything.
    """
    scored = totals.where(F.col("n_scored") > 0)
    if "needs_review_total" in totals.columns:
        rows = scored.select("class_id", "n_scored", "needs_review_total").join(stats, "class_id", "left")
    else:
        rows = scored.select("class_id", "n_scored").join(stats, "class_id", "left").withColumn(
            "needs_review_total", F.sum("needs_review").over(Window.partitionBy("class_id")))
    # the review action belongs to the class: the row of its first item carries it, or its only row where no item was judged
    first = F.coalesce("item_ord", F.lit(1)) == 1
    return _found(rows, _teaching(), _brief(), _rubric(), F.when(first, _review()))


def class_notes(totals: DataFrame) -> DataFrame:
    """(class_id, ok, reason, notes): what limits the strength of the conclusions."""
    n = F.col("n_scored")
    notes = F.array_compact(F.array(
        F.when(n < K.MIN_N_FOR_INSIGHT, F.concat(F.lit("small_sample:"), n.cast("string"))),
        F.when(F.col("n_incomplete") > 0, F.concat(F.lit("incomplete:"), F.col("n_incomplete").cast("string"))),
        F.when(F.col("n_retrieved") > 0, F.concat(F.lit("recall_mode:"), F.col("n_retrieved").cast("string")))))
    ok = n > 0
    return totals.select("class_id", ok.alias("ok"),
                         F.when(ok, "").otherwise("no_scored_reports").alias("reason"),
                         F.when(ok, notes).otherwise(F.array().cast("array<string>")).alias("notes"))


def focus_students(students: DataFrame, limit: int = K.FOCUS_LIMIT) -> DataFrame:
    """Lowest totals below the pass mark, at most ``limit`` per class."""
    low = students.where(F.col("total") < K.PASS_SCORE)
    return top_k(low, ["class_id"], [F.asc("total"), F.asc("report_id")], limit, "rank").select(
        "class_id", "rank", "report_id", "name", "total", "weakest", "weakest_gap")


def exemplars(students: DataFrame, limit: int = K.EXEMPLAR_LIMIT) -> DataFrame:
    """Best complete reports without misses or pending reviews."""
    good = students.where(F.col("total").isNotNull() & ~F.col("incomplete")
                          & (F.col("miss_count") == 0) & (F.col("needs_review") == 0))
    return top_k(good, ["class_id"], [F.desc("total"), F.asc("report_id")], limit, "rank").select(
        "class_id", "rank", "report_id", "name", "total")


def attention_list(students: DataFrame, fallback: int = K.ATTENTION_FALLBACK) -> DataFrame:
    """Everyone below the pass mark, incomplete or awaiting review; for a class with none, the lowest few."""
    needs = F.coalesce(F.col("total") < K.PASS_SCORE, F.lit(False)) | F.coalesce("incomplete", F.lit(False)) | (
        F.coalesce("needs_review", F.lit(0)) > 0)
    # whoever is flagged comes first, so the first few of a class also tell whether it has any
    few = top_k(students.withColumn("flagged", needs), ["class_id"], [F.desc("flagged"), F.asc_nulls_last("total"), F.asc("report_id")], fallback)
    any_ = F.max("flagged").over(Window.partitionBy("class_id"))
    quiet = few.withColumn("_any", any_).where(~F.col("_any")).drop("_any")
    return students.withColumn("flagged", needs).where("flagged").unionByName(quiet)


def build_cohort(stored: DataFrame, fresh: DataFrame, engine: str = "model",
                 existing_engine: str | None = None, force: bool = False) -> DataFrame:
    """Stored results of the model engine together with new records of one engine."""
    if existing_engine and existing_engine != engine and not force:
        raise ValueError(f"the stored cohort was made by '{existing_engine}', not '{engine}'; use force")
    return stored.where(F.col("engine") == "model").unionByName(fresh)


def mixed_engines(cohort: DataFrame) -> DataFrame:
    """Classes whose cohort holds more than one engine: their statistics must not be published."""
    return cohort.groupBy("class_id").agg(
        F.min("engine").alias("engine_a"), F.max("engine").alias("engine_b")).where("engine_a <> engine_b")


def quality_panel(totals: DataFrame) -> DataFrame:
    """What to read before the conclusions: (class_id, issue_ord, issue, value)."""
    def issue(i, name, condition, value):
        return F.when(condition, F.struct(F.lit(i).alias("issue_ord"), F.lit(name).alias("issue"),
                                          value.cast("double").alias("value")))
    n = F.col("n_scored")
    rows = F.array_compact(F.array(
        issue(1, "system_errors", F.col("n_incomplete") > 0, F.col("n_incomplete")),
        issue(2, "recall_mode", F.col("n_retrieved") > 0, F.col("n_retrieved")),
        issue(3, "pending_review", F.col("needs_review_total") > 0, F.col("needs_review_total")),
        issue(4, "small_sample", (n > 0) & (n < K.MIN_N_FOR_INSIGHT), n),
        issue(5, "low_separation", (n > 0) & (F.col("range") < K.SEPARATION_RANGE), F.col("range"))))
    return totals.select("class_id", F.inline(rows))
