"""Comparison with sealed human scores and quality metrics of graded batches.

Every function groups by ``batch_id`` so that many batches are measured in one pass.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import SCORE, as_units, mean, pearson as pearson_of, pop_stddev, ratio
from ..functions.rows import first_row
from .evidence import is_traceable


class GoldImport(NamedTuple):
    items: DataFrame      # report_id, item_id, score, verdict, evidence, note: complete reports only
    totals: DataFrame     # report_id, total: complete reports, rounded to one decimal
    excluded: DataFrame   # report_id: deliberately left blank
    problems: DataFrame   # report_id, item_id, problem: any row blocks the import


def import_gold(sheet: DataFrame, rubric: DataFrame) -> GoldImport:
    """All or nothing per report: full -> kept, blank -> excluded, anything else -> problem.

    ``sheet`` has text cells and ``row_no``, and ``file`` where it has several; of repeated rows the last one counts. ``rubric``
    gives item_id and max_score. A sheet without a single complete report is refused: problem ``no_complete_report``.
    """
    own = Window.partitionBy(*(["rubric_id"] if "rubric_id" in rubric.columns else [F.lit(0)]))
    limits = rubric.select("item_id", F.col("max_score").cast(SCORE).alias("max_score"), F.count("*").over(own).alias("rubric_size"))
    place = F.struct(*[F.col(c) for c in ("file", "row_no") if c in sheet.columns])
    cells = sheet.select(place.alias("_place"), *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in (
        "report_id", "item_id", "score", "verdict", "evidence", "note")])
    cells = cells.where((F.col("report_id") != "") & (F.col("item_id") != "")).join(limits, "item_id", "left")
    cells = cells.withColumn("value", F.expr("try_cast(score as decimal(9,2))"))
    problem = (F.when(F.col("score") == "", F.lit(None).cast("string"))
               .when(F.col("max_score").isNull(), "unknown_item")
               .when(F.col("value").isNull(), "not_a_number")
               .when((F.col("value") < 0) | (F.col("value") > F.col("max_score")), "out_of_range")
               .when(F.col("verdict") == "", "verdict_missing")
               .when(~F.col("verdict").isin(*K.VERDICTS), "verdict_unknown"))
    cells = cells.withColumn("problem", problem).withColumn("blank", F.col("score") == "")
    good = ~F.col("blank") & F.col("problem").isNull()
    filled = F.count_distinct(F.when(good, F.col("item_id")))
    state = cells.groupBy("report_id").agg(
        filled.alias("filled"), F.count_if("blank").alias("blanks"), F.max("rubric_size").alias("rubric_size"))
    partial = (F.col("filled") > 0) & (F.col("filled") < F.col("rubric_size"))
    whole = F.coalesce(F.col("filled") == F.col("rubric_size"), F.lit(False))
    items = first_row(cells.where(good), ["report_id", "item_id"], [F.desc("_place")]).join(
        state.where(whole).select("report_id"), "report_id", "left_semi").select(
        "report_id", "item_id", F.col("value").alias("score"), "verdict", "evidence", "note")
    none = state.agg(F.count_if(whole).alias("n")).where("n = 0")
    return GoldImport(
        items, items.groupBy("report_id").agg(F.bround(F.sum("score"), 1).alias("total")),
        state.where((F.col("filled") == 0) & (F.col("blanks") > 0)).select("report_id"),
        cells.where(F.col("problem").isNotNull()).select("report_id", "item_id", "problem").unionByName(
            state.where(partial).select("report_id", F.lit("").alias("item_id"), F.lit("partly_filled").alias("problem"))).unionByName(
            none.select(F.lit("").alias("report_id"), F.lit("").alias("item_id"), F.lit("no_complete_report").alias("problem"))))


def check_seal(seal: DataFrame) -> DataFrame:
    """(dataset_id, key, problem): required fields that are missing, independence answers that are not yes."""
    value = {k: F.max(F.when(F.col("key") == k, F.nullif(F.trim("value"), F.lit("")))) for k in K.SEAL_REQUIRED}
    answers = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"),
                                 F.lit(k in K.SEAL_MUST_BE_YES).alias("yes")) for k, v in value.items()])
    rows = seal.groupBy("dataset_id").agg(answers.alias("a")).select("dataset_id", F.inline("a"))
    problem = (F.when(F.col("value").isNull(), "missing")
               .when(F.col("yes") & (F.col("value") != K.SEAL_YES), "not_independent"))
    return rows.select("dataset_id", "key", problem.alias("problem")).where("problem is not null")


def _number_text(c: Column) -> Column:
    """A number as the published fingerprint writes it: 15.0, 7.5."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("None"))


def _score_lines(gold_items: DataFrame, totals: DataFrame | None) -> DataFrame:
    """(dataset_id, report_id, line): ``report:total|report/item=score|...`` with the items in order; one report's items at a time."""
    sets = ["dataset_id"] if "dataset_id" in gold_items.columns else []
    report = F.col("report_id").cast("string")
    per_report = gold_items.groupBy(*sets, "report_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), _number_text(F.col("score")).alias("s")))).alias("items"),
        F.bround(F.sum("score"), 1).alias("total"))
    if totals is not None:
        per_report = per_report.drop("total").join(totals.select(*sets, "report_id", "total"), [*sets, "report_id"], "left")
    items = F.transform("items", lambda i: F.concat(report, F.lit("/"), i["id"], F.lit("="), i["s"]))
    head = F.concat(report, F.lit(":"), _number_text(F.col("total")))
    return per_report.select(*(sets or [F.lit("").alias("dataset_id")]), report.alias("report_id"), F.concat_ws("|", head, F.array_join(items, "|")).alias("line"))


def score_fingerprint(gold_items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(dataset_id, reports, fingerprint): changes with any score or total, and with nothing else; for sets of any size.

    A tree of digests over sorted ranges: reports are leaves in the order of the digest of their id, whose first six and then
    three hex digits are the ranges of the two levels above. No node has more than 4096 children but those of the lowest level,
    which grow by one for every 16.7 million reports; no order or partitioning of the input shows in the root.
    """
    place, line = F.sha2(F.col("report_id"), 256), F.sha2(F.col("line"), 256)
    level = _score_lines(gold_items, totals).select("dataset_id", F.lit(1).cast("bigint").alias("n"), place.alias("at"), line.alias("digest"))
    for digits in (6, 3, 0):
        level = level.groupBy("dataset_id", F.left("at", F.lit(digits)).alias("range")).agg(
            F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("parts")).select(
            "dataset_id", "n", F.col("range").alias("at"), F.sha2(F.array_join(F.transform("parts", lambda p: p["digest"]), ""), 256).alias("digest"))
    return level.select("dataset_id", F.col("n").alias("reports"), F.left("digest", F.lit(16)).alias("fingerprint"))


def published_fingerprint(gold_items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(dataset_id, reports, fingerprint): the published value, a hash over the lines of a whole set in the order of report ids.

    Such a hash can only be taken in sequence. Each set is hashed by one task that reads its sorted lines as a stream, so
    memory is bounded by a batch whatever the set; many sets are hashed side by side. Use ``score_fingerprint`` for huge sets.
    """
    lines = _score_lines(gold_items, totals)

    def run(batches):
        import hashlib

        import pyarrow as pa
        done: list[tuple] = []
        now, n, digest = None, 0, hashlib.sha256()
        for batch in batches:
            for dataset, line in zip(batch.column("dataset_id").to_pylist(), batch.column("line").to_pylist()):
                if n and dataset != now:
                    done.append((now, n, digest.hexdigest()[:16]))
                    n, digest = 0, hashlib.sha256()
                digest.update((("|" if n else "") + line).encode())
                now, n = dataset, n + 1
        if n:
            done.append((now, n, digest.hexdigest()[:16]))
        yield pa.RecordBatch.from_pydict({"dataset_id": pa.array([d for d, _, _ in done], kind), "reports": pa.array([n for _, n, _ in done], pa.int64()),
                                          "fingerprint": pa.array([h for _, _, h in done], pa.string())})

    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(lines.schema["dataset_id"].dataType)
    ordered = lines.repartition("dataset_id").sortWithinPartitions("dataset_id", "report_id")
    return ordered.select("dataset_id", "line").mapInArrow(run, f"dataset_id {dict(lines.dtypes)['dataset_id']}, reports long, fingerprint string")


def gold_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows where two gold tables disagree, in both directions (full outer join, null-safe)."""
    a = left.select("report_id", "item_id", F.struct("score", "verdict").alias("a"))
    b = right.select("report_id", "item_id", F.struct("score", "verdict").alias("b"))
    return a.join(b, ["report_id", "item_id"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(
        "report_id", "item_id",
        F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").otherwise("changed")
        .alias("difference"))


def compare_totals(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Every gold report with the system total when there is one; difference rounded to 1 decimal."""
    joined = gold.join(results.select("report_id", F.col("total").alias("ai")), "report_id", "left")
    diff = F.bround(F.col("ai") - F.col("gold"), 1)
    return joined.withColumn("diff", diff).withColumn(
        "status", F.when(F.col("ai").isNull(), "not_evaluated").otherwise("compared"))


def _mae_columns(tolerance: int = 5) -> list[Column]:
    gap = F.abs("diff")
    return [F.count("diff").alias("n"), mean(gap).alias("mae"),
            ratio(100 * F.count_if(gap <= tolerance), F.count("diff")).alias("within")]


def _pearson_column() -> Column:
    return pearson_of(as_units(F.col("gold"), 100), as_units(F.col("ai"), 100)).alias("pearson")


def mae_within(compared: DataFrame, tolerance: int = 5) -> DataFrame:
    """(batch_id, n, mae, within): mean absolute difference and share within the tolerance."""
    return compared.groupBy("batch_id").agg(*_mae_columns(tolerance))


def pearson(compared: DataFrame) -> DataFrame:
    """(batch_id, n, pearson): NULL for fewer than 3 pairs or a constant side."""
    both = F.col("gold").isNotNull() & F.col("ai").isNotNull()
    return compared.groupBy("batch_id").agg(F.count_if(both).alias("n"), _pearson_column())


def item_agreement(gold_items: DataFrame, judgements: DataFrame) -> DataFrame:
    """(batch_id, compared, agreed, agreement): verdicts equal, only where the human gave one."""
    gold = gold_items.where(F.coalesce("verdict", F.lit("")) != "").select(
        "report_id", "item_id", F.col("verdict").alias("gold_verdict"))
    same = F.col("verdict") == F.col("gold_verdict")
    return judgements.join(gold, ["report_id", "item_id"]).groupBy("batch_id").agg(
        F.count("*").alias("compared"), F.count_if(same).alias("agreed"),
        ratio(100 * F.count_if(same), F.count("*")).alias("agreement"))


def traceability(quotes: DataFrame, texts: DataFrame, by: str = "batch_id") -> DataFrame:
    """(by, checked, ok, rate) over kept and dropped quotes; empty strings are skipped.

    Equal quotes of a report are counted together before they meet the text.
    """
    counted = quotes.where(F.coalesce("quote", F.lit("")) != "").groupBy(by, "report_id", "quote").agg(
        F.count("*").alias("n"))
    joined = counted.join(texts.select("report_id", "full_text"), "report_id", "left")
    ok = F.when(is_traceable(F.col("quote"), F.coalesce("full_text", F.lit(""))), F.col("n")).otherwise(0)
    return joined.select(by, "n", ok.alias("ok")).groupBy(by).agg(
        F.sum("n").alias("checked"), F.sum("ok").alias("ok"),
        ratio(100 * F.sum("ok"), F.sum("n")).alias("rate"))


def cost_and_review(judgements: DataFrame, results: DataFrame) -> DataFrame:
    """(batch_id, judged, review_rate, system_error_rate, latency_sum, latency_avg, tokens)."""
    per_item = judgements.groupBy("batch_id").agg(
        F.count("*").alias("judged"),
        ratio(100 * F.count_if("needs_review"), F.count("*")).alias("review_rate"),
        ratio(100 * F.count_if(F.coalesce("system_error", F.lit("")) != ""), F.count("*")).alias("system_error_rate"))
    per_report = results.groupBy("batch_id").agg(
        F.sum("elapsed_sec").alias("latency_sum"), mean(F.col("elapsed_sec")).alias("latency_avg"),
        F.sum("tokens").alias("tokens"))
    return per_item.join(per_report, "batch_id", "full")


def _discrimination_columns(t: Column) -> list[Column]:
    perfect = F.count_if(t >= K.PERFECT_SCORE)
    return [F.max(t).cast("double").alias("max"), F.min(t).cast("double").alias("min"),
            (F.max(t) - F.min(t)).cast("double").alias("range"), pop_stddev(as_units(t, 10), 10).alias("stdev"),
            perfect.alias("perfect_count"), ratio(100 * perfect, F.count(t)).alias("perfect_ratio")]


def discrimination(results: DataFrame, total: str = "total") -> DataFrame:
    """(batch_id, n, max, min, range, stdev, perfect_count, perfect_ratio)."""
    t = F.col(total)
    return results.groupBy("batch_id").agg(F.count(t).alias("n"), *_discrimination_columns(t))


def benchmark_report(compared: DataFrame, agreement: DataFrame, cost: DataFrame,
                     trace: DataFrame | None = None) -> DataFrame:
    """One row per batch with every metric.

    All report-level figures come from one aggregate over the comparison; the other inputs are already
    one row per batch.
    """
    out = compared.groupBy("batch_id").agg(
        *_mae_columns(), _pearson_column(), F.count_if(F.col("ai").isNull()).alias("not_evaluated"),
        *_discrimination_columns(F.col("ai"))).withColumnRenamed("n", "reports")
    for part in (agreement, cost, trace):
        if part is not None:
            out = out.join(part, "batch_id", "left")
    return out


def batch_spread(results: DataFrame) -> DataFrame:
    """(batch_id, n, lowest, highest, range, separates): a range of 15 tells good from bad."""
    t = F.col("total")
    spread = F.max(t) - F.min(t)
    return results.where(t.isNotNull()).groupBy("batch_id").agg(
        F.count(t).alias("n"), F.min(t).cast("double").alias("lowest"), F.max(t).cast("double").alias("highest"),
        spread.cast("double").alias("range"), (spread >= K.SEPARATION_RANGE).alias("separates"))


def sorted_totals(results: DataFrame) -> DataFrame:
    """All totals of every batch in ascending order, as rows (a distributed sort, never one array)."""
    return results.where(F.col("total").isNotNull()).select("batch_id", "report_id", "total").orderBy(
        "batch_id", "total", "report_id")


def batch_matrix(judgements: DataFrame, item_ids: list[str], results: DataFrame,
                 gold: DataFrame | None = None, rubric_is_fixed: bool = True) -> DataFrame:
    """Report rows with the length of the report (``chars``, null where the results have none), one score column per item,
    review count, total and, for the fixed rubric, the gold gap."""
    scores = [F.max(F.when(F.col("item_id") == i, F.col("score"))).alias(i) for i in item_ids]
    wide = judgements.groupBy("report_id").agg(F.count_if("needs_review").alias("needs_review"), *scores)
    chars = F.col("chars").cast("long") if "chars" in results.columns else F.lit(None).cast("long")
    out = results.select("report_id", chars.alias("chars"), "total").join(wide, "report_id", "left")
    if gold is None:
        return out
    if not rubric_is_fixed:
        raise ValueError("gold scores belong to the fixed rubric; a gap against another rubric has no meaning")
    out = out.join(gold.select("report_id", "gold"), "report_id", "left")
    return out.withColumn("diff", F.bround(F.col("total") - F.col("gold"), 1))


def admit_batch(reports: DataFrame, limit: int = K.BATCH_SKIP_CHARS, only: DataFrame | None = None,
                include_long: bool = False) -> DataFrame:
    """Every chosen report with admitted / reason; over-long ones are skipped unless asked for."""
    chosen = reports.join(only, "report_id", "left_semi") if only is not None else reports
    too_long: Column = F.lit(False) if include_long else F.col("chars") > limit
    return chosen.select("report_id", "chars", (~too_long).alias("admitted"),
                         F.when(too_long, "too_long").otherwise("").alias("reason"))
