"""Judgements: normalising model outputs, choosing attempts, guarding consistency, totals and the rule engine.

Model outputs arrive as tables; no model is called. Keys are (report_id, item_id) throughout, and
``score`` is an exact decimal.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.numbers import SCORE, clamp, ratio
from ..functions.rows import first_row, once, top_k
from .evidence import KEY, flag, is_traceable, no_quotes, with_texts
from .sections import coverage_of, with_rubric


def _join_rubric(rows: DataFrame, rubric: DataFrame, how: str, *columns: Column) -> DataFrame:
    """Meet the rubric on item_id, and on rubric_id too when the rows carry one (many rubrics at once).

    Rows without a rubric_id can only meet one rubric: an item that several rubrics have stops the job.
    """
    keys = ["rubric_id", "item_id"] if "rubric_id" in rows.columns else ["item_id"]
    if "rubric_id" not in rows.columns and "rubric_id" in rubric.columns:
        same = Window.partitionBy("item_id")
        sole = F.min("rubric_id").over(same).eqNullSafe(F.max("rubric_id").over(same))
        rubric = rubric.withColumn("item_id", F.when(sole, F.col("item_id")).otherwise(
            F.raise_error(F.lit("rows without rubric_id, but several rubrics have this item"))))
    return rows.join(rubric.select(*keys, *columns), keys, how)


def _max(name: str = "max_score") -> Column:
    return F.col("max_score").cast(SCORE).alias(name)


def normalize_judgements(raw: DataFrame, rubric: DataFrame) -> DataFrame:
    """Bring raw verdict, score and confidence (text or number) into range; ``notes`` lists what was changed.

    Contradictions between verdict and score are marked for review, the score is never bent to fit.
    """
    j = _join_rubric(raw, rubric, "left", _max())
    top = F.coalesce(F.nullif("max_score", F.lit(0).cast(SCORE)), F.lit(100).cast(SCORE))
    legal = F.coalesce(F.col("verdict").isin(*K.VERDICTS), F.lit(False))
    confidence, score = (F.col(c).cast("string") for c in ("confidence", "score"))
    conf_number = F.when(confidence.isNull() | F.lower(confidence).isin("true", "false"), F.lit(0.0)).otherwise(
        confidence.try_cast("double"))
    score_number = score.try_cast("decimal(18,4)")
    j = j.withColumns({
        "max_score": top,
        "_legal": legal,
        "verdict": F.when(legal, F.col("verdict")).otherwise("partial"),
        "_conf_ok": conf_number.isNotNull(),
        "confidence": clamp(F.coalesce(conf_number, F.lit(0.0)), 0.0, 1.0),
        "_score_ok": score_number.isNotNull(),
        "score": F.coalesce(score_number, F.lit(0)).cast("decimal(18,4)"),
        "evidence": F.coalesce("evidence", no_quotes()),
    })
    j = j.withColumn("score", clamp(F.col("score"), F.lit(0).cast("decimal(18,4)"),
                                    F.col("max_score").cast("decimal(18,4)")).cast(SCORE))
    miss = F.col("verdict") == "miss"
    j = j.withColumns({"_dropped_score": miss & (F.col("score") != 0), "_dropped_evidence": miss & (F.size("evidence") > 0)})
    j = j.withColumns({"score": F.when(miss, F.lit(0)).otherwise(F.col("score")).cast(SCORE),
                       "evidence": F.when(miss, no_quotes()).otherwise(F.col("evidence"))})
    share = ratio(F.col("score"), F.col("max_score"))
    in_band = F.lit(False)
    for verdict, (low, high) in K.SCORE_BANDS.items():
        in_band = in_band | ((F.col("verdict") == verdict)
                             & share.between(low - K.BAND_TOLERANCE, high + K.BAND_TOLERANCE))
    notes = F.array_compact(F.array(
        F.when(~F.col("_legal"), "illegal_verdict"), F.when(~F.col("_conf_ok"), "confidence_not_a_number"),
        F.when(~F.col("_score_ok"), "score_not_a_number"), F.when(F.col("_dropped_score"), "miss_score_zeroed"),
        F.when(F.col("_dropped_evidence"), "miss_evidence_cleared"), F.when(~in_band, "score_outside_band")))
    review = ~F.col("_legal") | ~F.col("_conf_ok") | ~F.col("_score_ok") | ~in_band
    return j.withColumns({"notes": notes, "needs_review": review}).drop(
        "_legal", "_conf_ok", "_score_ok", "_dropped_score", "_dropped_evidence")


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """One judgement per (report, item) from verified attempts 1 and 2.

    First when valid, else second when valid, else a clean miss that keeps the first attempt's
    quotes as dropped; a failed call is a system error, never the student's miss. ``reason`` goes along where attempts have
    one. Of repeated attempts the one with the least ``pos`` counts (without that column the least by content).
    """
    reason = F.coalesce("reason", F.lit("")) if "reason" in attempts.columns else F.lit("")
    fields = F.struct("verdict", "score", F.col("confidence").alias("confidence"), "evidence", "dropped_quotes",
                      "needs_review", "valid", F.coalesce("error", F.lit("")).alias("error"), reason.alias("reason"))
    place = F.col("pos") if "pos" in attempts.columns else F.xxhash64("verdict", "score", "confidence", "evidence", "error")

    def attempt(number: int) -> Column:
        return F.min_by(fields, F.when(F.col("attempt_no") == number, place))

    both = attempts.groupBy(*KEY).agg(attempt(1).alias("a"), attempt(2).alias("b"))
    a, b = F.col("a"), F.col("b")
    b_failed = b.isNotNull() & (b["error"] != "")
    outcome = (F.when(a.isNull(), "system_error").when(a["error"] != "", "system_error")
               .when(a["valid"], "first").when(b_failed, "system_error")
               .when(F.coalesce(b["valid"], F.lit(False)), "second").otherwise("degraded"))
    both = both.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome") == "first", a).when(F.col("outcome") == "second", b)
    failed, degraded = F.col("outcome") == "system_error", F.col("outcome") == "degraded"
    error = F.when(a.isNull(), "no attempt").when(a["error"] != "", a["error"]).otherwise(b["error"])
    both = both.withColumn("c", chosen)
    return both.select(
        *KEY, "outcome",
        F.coalesce("c.verdict", F.lit("miss")).alias("verdict"),
        F.coalesce("c.score", F.lit(0)).cast(SCORE).alias("score"),
        F.coalesce("c.confidence", F.when(degraded, a["confidence"]), F.lit(0)).cast("double").alias("confidence"),
        F.coalesce("c.evidence", no_quotes()).alias("evidence"),
        F.coalesce("c.dropped_quotes", F.when(degraded, a["dropped_quotes"]), no_quotes()).alias("dropped_quotes"),
        F.coalesce("c.needs_review", F.lit(True)).alias("needs_review"),
        F.when(failed, error).otherwise("").alias("system_error"),
        F.coalesce("c.reason", F.when(degraded, a["reason"]), F.lit("")).alias("reason"))


def consistency_guard(first: DataFrame, second: DataFrame, rubric: DataFrame,
                      threshold: float = K.RECHECK_CONFIDENCE, gap: float = K.RECHECK_SCORE_GAP) -> DataFrame:
    """The second pass only raises review flags; verdict and score of the first pass stand.

    ``second`` carries valid and error. Confident unflagged hits are not rechecked at all.
    """
    s = second.select(*KEY, F.struct("verdict", "score", "valid", F.coalesce("error", F.lit("")).alias("error"))
                      .alias("_second"))
    j = _join_rubric(first, rubric, "left", _max()).join(s, KEY, "left")
    certain = (F.col("confidence") >= threshold) & (F.col("verdict") == "hit") & ~F.col("needs_review")
    t = F.col("_second")
    failed = t.isNull() | (t["error"] != "")
    allowed = F.col("max_score") * F.lit(gap).cast("decimal(4,2)")
    checks = F.array_compact(F.array(
        F.when(failed, "recheck_failed"),
        F.when(~failed & (F.col("confidence") < threshold), "low_confidence"),
        F.when(~failed & (t["verdict"] != F.col("verdict")), "verdicts_differ"),
        F.when(~failed & (F.abs(t["score"] - F.col("score")) > allowed), "score_gap")))
    reasons = F.when(certain, no_quotes()).otherwise(checks)
    unverified = ~certain & ~failed & ~F.coalesce(t["valid"], F.lit(True))
    return j.withColumns({"guard_reasons": reasons, "second_unverified": F.coalesce(unverified, F.lit(False))}).withColumn(
        "needs_review", F.col("needs_review") | (F.size("guard_reasons") > 0)).drop("_second", "max_score")


def report_totals(judgements: DataFrame) -> DataFrame:
    """(report_id, total, total_incomplete, system_errors): the sum is computed here, never by a model."""
    failed = F.coalesce("system_error", F.lit("")) != ""
    return judgements.groupBy("report_id").agg(
        F.bround(F.sum("score"), 1).alias("total"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("total_incomplete"),
        F.count_if(failed).alias("system_errors"))


def accepted_overrides(judgements: DataFrame, overrides: DataFrame) -> DataFrame:
    """The newest override with a reason per judged item that really changes the score."""
    reasoned = overrides.where(F.trim(F.coalesce("reason", F.lit(""))) != "")
    newest = first_row(reasoned, KEY, [F.desc("created_at"), F.desc("new_score")])
    known = newest.join(judgements.select(*KEY, F.col("score").alias("original_score")), KEY)
    return known.where(F.abs(F.col("new_score") - F.col("original_score")) >= F.lit(0.01).cast(SCORE)).select(
        *KEY, "original_score", F.col("new_score").cast(SCORE).alias("new_score"), "reason", "created_at")


def rejected_overrides(judgements: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides without a reason or for an item that was never judged."""
    unknown = overrides.join(judgements.select(*KEY), KEY, "left_anti").withColumn("rejected", F.lit("unknown_item"))
    silent = overrides.join(judgements.select(*KEY), KEY, "left_semi").where(
        F.trim(F.coalesce("reason", F.lit(""))) == "").withColumn("rejected", F.lit("no_reason"))
    return unknown.unionByName(silent)


def effective_scores(judgements: DataFrame, accepted: DataFrame) -> DataFrame:
    """Judgements with the score that counts; the original score stays beside it."""
    return judgements.join(accepted.select(*KEY, "new_score", F.col("reason").alias("override_reason")), KEY, "left"
                           ).withColumn("final_score", F.coalesce("new_score", "score").cast(SCORE))


def apply_overrides(judgements: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per report: recomputed total beside the AI total and the number of overrides in force."""
    rows = effective_scores(judgements, accepted_overrides(judgements, overrides))
    return rows.groupBy("report_id").agg(
        F.bround(F.sum("final_score"), 1).alias("total"), F.bround(F.sum("score"), 1).alias("ai_total"),
        F.count("new_score").alias("overrides"))


def export_rows(effective: DataFrame, rubric: DataFrame) -> DataFrame:
    """One row per rubric item and one total row per report (item_ord 0 sorts it last on display)."""
    named = _join_rubric(effective, rubric, "inner", F.col("ord").alias("item_ord"), F.col("name"), _max("top"))
    lines = named.select(
        "report_id", "item_ord", "name", "verdict", F.col("score").alias("ai_score"), "final_score", "top",
        F.when(F.col("needs_review"), "yes").otherwise("").alias("needs_review"),
        F.coalesce("system_error", F.lit("")).alias("system_error"),
        F.coalesce("override_reason", F.lit("")).alias("override_reason"),
        (F.col("confidence") if "confidence" in effective.columns else F.lit(None)).cast("double").alias("confidence"),
        (F.coalesce("reason", F.lit("")) if "reason" in effective.columns else F.lit("")).alias("reason"),
        F.array_join("evidence", " | ").alias("evidence"))
    # lines of a report are rubric items; gathered once, they give the total too
    columns = [c for c in lines.columns if c != "report_id"]
    gathered = lines.groupBy("report_id").agg(F.collect_list(F.struct(*columns)).alias("lines"), F.sum("ai_score").cast(SCORE).alias("ai"),
                                              F.sum("final_score").cast(SCORE).alias("final"))
    total = {"item_ord": F.lit(0), "name": F.lit("total"), "ai_score": F.col("ai"), "final_score": F.col("final"),
             "top": F.lit(100).cast(SCORE), "confidence": F.lit(None).cast("double")}
    return gathered.select("report_id", F.inline(F.concat("lines", F.array(F.struct(*[
        total.get(c, F.lit("")).alias(c) for c in columns])))))


# ---- the rule engine ---------------------------------------------------------------
_SENTENCE = r"^[^\n。；！？!?;]*[\n。；！？!?;]?"


def quote_at(text: Column, signal: Column) -> Column:
    """From the signal to the end of its sentence, fitted into the quote length window; '' when absent.

    A supporting quote starts at the signal itself: the backward search of the sentence start never
    gets past the signal position in the published behaviour, so it is not made here either.
    """

    def cut(at: Column) -> Column:
        # canonical text has no two spaces in a row, so this window decides every quote exactly
        window = X.piece(text, at, F.length(signal) + K.QUOTE_MAX_LEN + 2)

        def sentence(w: Column) -> Column:
            rest = F.substring(w, F.length(signal) + 1, F.lit(K.QUOTE_MAX_LEN + 2))
            return X.strip(F.concat(signal, F.regexp_extract(rest, _SENTENCE, 0)))

        padded = X.strip(X.piece(text, at, F.lit(K.QUOTE_MIN_LEN + 20)))
        fitted = X.bind(X.bind(window, sentence), lambda q: F.when(F.length(q) < K.QUOTE_MIN_LEN, padded).when(
            F.length(q) > K.QUOTE_MAX_LEN, X.strip(F.left(q, F.lit(K.QUOTE_MAX_LEN)))).otherwise(q))
        return F.when(at < 0, "").otherwise(fitted)

    return X.bind(X.find(text, signal), cut)


def first_quote(text: Column, signals: Column) -> Column:
    """The quote of the first signal that yields one long enough; '' when none does."""
    quotes = F.filter(F.transform(F.filter(signals, lambda s: s != ""), lambda s: quote_at(text, s)),
                      lambda q: F.length(q) >= K.QUOTE_MIN_LEN)
    return F.coalesce(F.get(quotes, F.lit(0)), F.lit(""))


def _signals_of(item: Column) -> Column:
    """Positive signals; without any, the words of the item name (2 characters and up)."""
    from_name = F.filter(F.split(F.coalesce(item["name"], F.lit("")), r"(?U)[^\w一-鿿]+"), lambda w: F.length(w) >= 2)
    given = item["positive_signals"]
    return F.when(F.size(F.coalesce(given, no_quotes())) > 0, given).otherwise(from_name)


def rule_judgement(text: Column, item: Column) -> Column:
    """Verdict of one item from the share of its signals found in the text, as a struct."""

    def decide(p: Column) -> Column:
        share = F.try_divide(F.size(p["hits"]).cast("double"), F.greatest(F.size(p["signals"]), F.lit(1)).cast("double"))
        none, quoted = F.size(p["hits"]) == 0, p["quote"] != ""
        verdict = F.when(none, "miss").when(quoted & (share >= 0.75), "hit").otherwise("partial")
        factor = (F.when(none, F.lit("0")).when(~quoted, F.lit("0.3")).when(share >= 0.75, F.lit("0.9"))
                  .when(share >= 0.4, F.lit("0.65")).otherwise(F.lit("0.4"))).cast("decimal(3,2)")
        return F.struct(
            item["item_id"].alias("item_id"), item["ord"].alias("item_ord"), verdict.alias("verdict"),
            F.bround(item["max_score"] * factor, 1).cast(SCORE).alias("score"), item["max_score"].alias("max_score"),
            F.when(none, 0.35).otherwise(0.5).alias("confidence"),
            F.when(~none & quoted, F.array(p["quote"])).otherwise(no_quotes()).alias("evidence"),
            p["hits"].alias("hits"),
            X.contained(F.coalesce(item["negative_signals"], no_quotes()), text).alias("negative_hits"))

    def found(signals: Column) -> Column:
        return X.bind(X.contained(signals, text), lambda hits: X.bind(
            F.struct(signals.alias("signals"), hits.alias("hits"),
                     F.when(F.size(hits) > 0, first_quote(text, hits)).otherwise("").alias("quote")), decide))

    return X.bind(_signals_of(item), found)


def rule_judge(texts: DataFrame, rubric: DataFrame) -> DataFrame:
    """Rule judgements of every report for every item of its rubric; all need review.

    The rubric travels as an array on the report row, so the text is scanned in place and only
    the small result rows are multiplied. A report whose rubric is unknown or empty has one row without
    an item and the system error ``no_rubric``.
    """
    keep = ["rubric_id"] + [c for c in ("class_id", "batch_id") if c in texts.columns]
    rows = with_rubric(texts, rubric)
    judged = rows.select("report_id", *keep, F.transform(
        "items", lambda it: rule_judgement(F.coalesce(F.col("full_text"), F.lit("")), it)).alias("_j"))
    return judged.select("report_id", *keep, F.inline_outer("_j")).withColumns(
        {"needs_review": F.lit(True), "system_error": F.when(F.col("item_id").isNull(), "no_rubric").otherwise(""),
         "dropped_quotes": no_quotes()})


def lost_points(judgements: DataFrame, rubric: DataFrame, k: int = 3) -> DataFrame:
    """The k items that cost a report most, among those not fully reached."""
    weak = _join_rubric(judgements.where(F.col("verdict").isin(*K.WEAK_VERDICTS)), rubric, "inner",
                        F.col("ord"), F.col("name"), _max("top"))
    weak = weak.withColumn("lost", (F.col("top") - F.col("score")).cast(SCORE))
    return top_k(weak, ["report_id"], [F.desc("lost"), F.col("ord")], k, "rank").select(
        "report_id", "rank", "item_id", "name", "verdict", "lost")


def rule_feedback(judgements: DataFrame, rubric: DataFrame) -> DataFrame:
    """(report_id, not_full, missing, suggestions): up to 3 missing and 2 partial items, in rubric order."""
    weak = _join_rubric(judgements.where(F.col("verdict") != "hit"), rubric, "inner", F.col("ord"))
    # a report has at most one row per rubric item here
    per_report = weak.groupBy("report_id").agg(
        F.count("*").alias("not_full"), F.count_if(F.col("verdict") == "miss").alias("missing"),
        F.array_sort(F.collect_list(F.struct("ord", "item_id", "verdict"))).alias("_w"))

    def pick(missing: bool, n: int) -> Column:
        chosen = F.filter("_w", lambda s: (s["verdict"] == "miss") if missing else (s["verdict"] != "miss"))
        lead = "missing:" if missing else "partial:"
        return F.transform(F.slice(chosen, 1, n), lambda s: F.concat(F.lit(lead), s["item_id"]))

    return per_report.select("report_id", "not_full", "missing", F.concat(pick(True, 3), pick(False, 2)).alias("suggestions"))


def grade_offline(texts: DataFrame, rubric: DataFrame) -> DataFrame:
    """Whole offline grading, one row per report, without any shuffle of judgement rows.

    Judgements, total, feedback counts, coverage and the text hash are all computed on the report row. A report whose
    rubric is unknown or empty has no judgements, no total and ``total_incomplete``.
    """
    rows = with_rubric(texts, rubric)
    keep = ["rubric_id"] + [c for c in ("class_id", "batch_id") if c in texts.columns]
    text = F.coalesce(F.col("full_text"), F.lit(""))
    judged = rows.select("report_id", *keep, F.length(text).alias("chars"),
                         F.left(F.sha2(text, 256), F.lit(16)).alias("report_hash"),
                         F.transform(F.coalesce("items", F.array().cast(rows.schema["items"].dataType)),
                                     lambda it: rule_judgement(text, it)).alias("judgements"))
    graded = F.size("judgements") > 0
    zero = F.lit(0).cast("decimal(12,2)")
    total = F.aggregate("judgements", zero, lambda acc, j: (acc + j["score"]).cast("decimal(12,2)"))
    weak = F.filter("judgements", lambda j: j["verdict"] != "hit")
    missing = F.filter("judgements", lambda j: j["verdict"] == "miss")
    partial = F.filter("judgements", lambda j: j["verdict"] == "partial")
    suggestions = F.concat(
        F.transform(F.slice(missing, 1, 3), lambda j: F.concat(F.lit("missing:"), j["item_id"])),
        F.transform(F.slice(partial, 1, 2), lambda j: F.concat(F.lit("partial:"), j["item_id"])))
    return judged.select("report_id", *keep, "chars", "report_hash", coverage_of(F.col("chars")).alias("coverage"),
                         F.when(graded, F.bround(total, 1)).alias("total"), (~graded).alias("total_incomplete"),
                         F.size(weak).alias("not_full"), F.size(missing).alias("missing"),
                         suggestions.alias("suggestions"), "judgements")


# ---- stored results ----------------------------------------------------------------
def audit_results(results: DataFrame, judgements: DataFrame, rubric: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Problems of stored results: (report_id, item_id, problem).

    Checks: every quote verbatim, total = sum, rule-engine rows flagged, item known, score within its maximum.
    """
    stored = results.select("report_id", "total", "engine")
    rows = _join_rubric(judgements, rubric, "left", _max())

    def problems(r, *more: Column) -> list[Column]:
        return [F.when(r["max_score"].isNull(), "unknown_item"),
                F.when(r["score"] > r["max_score"] + F.lit(0.01).cast(SCORE), "over_maximum"),
                F.when(~r["needs_review"] & (F.col("engine") == "rule"), "rule_row_not_flagged"), *more]

    wrong_total = F.abs(F.col("total") - F.coalesce("_sum", F.lit(0))) > F.lit(0.05).cast(SCORE)
    if texts is not None:
        return _audit_with_texts(rows, stored, texts, problems, wrong_total)
    named = {n: F.col(n) for n in ("max_score", "score", "needs_review")}
    rows = rows.join(stored.select("report_id", "engine"), "report_id", "left")
    per_row = rows.select(*KEY, F.explode(F.array_compact(F.array(*problems(named)))).alias("problem"))
    sums = judgements.groupBy("report_id").agg(F.sum("score").alias("_sum"))
    wrong = stored.join(sums, "report_id", "left").where(wrong_total).select(
        "report_id", F.lit("").alias("item_id"), F.lit("total_is_not_sum").alias("problem"))
    return per_row.unionByName(wrong)


def _audit_with_texts(rows: DataFrame, stored: DataFrame, texts: DataFrame, problems, wrong_total: Column) -> DataFrame:
    """The audit on one row per report (rubric items of it), so judgements are read and each text is met once."""
    row = F.struct("item_id", "max_score", "score", "needs_review", F.coalesce("evidence", no_quotes()).alias("evidence"))
    reports = rows.groupBy("report_id").agg(F.sum("score").alias("_sum"), F.collect_list(row).alias("_rows")).join(stored, "report_id", "full")
    reports = with_texts(reports, texts)
    text = F.coalesce("full_text", F.lit(""))

    def of_row(r: Column) -> Column:
        altered = F.when(F.exists(r["evidence"], lambda q: (q != "") & ~F.contains(text, q)), "quote_not_in_text")
        return F.transform(F.array_compact(F.array(*problems(r, altered))), lambda p: F.struct(r["item_id"].alias("item_id"), p.alias("problem")))

    of_report = F.struct(F.lit("").alias("item_id"), F.lit("total_is_not_sum").alias("problem"))
    found = F.concat(F.coalesce(F.flatten(F.transform("_rows", of_row)), F.array().cast("array<struct<item_id:string,problem:string>>")),
                     F.when(wrong_total, F.array(of_report)).otherwise(F.array().cast("array<struct<item_id:string,problem:string>>")))
    return once(reports, "_found", found).select("report_id", F.inline("_found"))


def as_records(judgements: DataFrame, rubric: DataFrame, results: DataFrame) -> DataFrame:
    """Nested batch records, items in rubric order; name and maximum come from the rubric.

    The nested list of a report holds one entry per rubric item (first judgement wins before nesting).
    """
    rows = _join_rubric(judgements, rubric, "left", F.col("ord"), F.col("name"), _max("max"))
    detail = F.struct(
        F.coalesce("ord", F.lit(0)).alias("ord"), F.col("item_id").alias("id"),
        F.coalesce("name", "item_id").alias("name"), "verdict", F.col("score").alias("s"), "max", "confidence",
        "needs_review", F.coalesce("system_error", F.lit("")).alias("system_error"), "evidence",
        F.col("dropped_quotes").alias("dropped"))
    nested = rows.groupBy("report_id").agg(F.array_sort(F.collect_list(detail)).alias("_d"))
    keep = [c for c in ("class_id", "batch_id", "name", "total", "chars", "coverage", "total_incomplete") if c in results.columns]
    return results.select("report_id", *keep).join(nested, "report_id", "left").withColumn(
        "details", F.transform("_d", lambda d: d.dropFields("ord"))).drop("_d")


def run_info(attempts: DataFrame, judgements: DataFrame, inspected: DataFrame | None = None) -> DataFrame:
    """(report_id, calls, tokens, failed_calls, json_repaired, system_errors[, chars, report_hash])."""
    calls = attempts.groupBy("report_id").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_calls"),
        F.count_if("repaired").alias("json_repaired"))
    errors = judgements.groupBy("report_id").agg(
        F.count_if(F.coalesce("system_error", F.lit("")) != "").alias("system_errors"))
    out = calls.join(errors, "report_id", "left").withColumn("system_errors", F.coalesce("system_errors", F.lit(0)))
    if inspected is None:
        return out
    hashed = inspected.select("report_id", F.length("full_text").alias("chars"),
                              F.left(F.sha2("full_text", 256), F.lit(16)).alias("report_hash"))
    return out.join(hashed, "report_id", "left")
