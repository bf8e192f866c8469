"""The evidence chain on one row per report: answers gathered once, everything after that as array work on the row.

``judge_reports`` meets each report's answers with its text by the only exchange on ``report_id``; verifying quotes, choosing
attempts, locating evidence, all review flags, totals, rates and run information then read columns of that row, so no further
text is scanned or shuffled. With texts kept in a bucketed table (``sources.tables``) the text side is not shuffled either.

A row holds the answers of one report: rubric items times attempts. ``repeated_answers`` lists what breaks that bound (an
attempt number given more than once) as a gate before the gathering; without the gate the first of the repeated counts for the
judgement, and all of them count as calls. Answers for unknown reports are kept, with no text and so without valid evidence;
reports without answers have no row. Null evidence is no evidence, null quotes are empty ones.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.numbers import SCORE, ratio
from ..functions.rows import once
from .evidence import is_traceable, no_quotes, tidy_quote
from .sections import injection_labels, injection_snippet, section_at


def _field(attempts: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name) if name in attempts.columns else F.lit(default).alias(name)


def repeated_answers(attempts: DataFrame) -> DataFrame:
    """(report_id, item_id, attempt_no, n): attempts that are there more than once; map-side counts, nothing is gathered."""
    return attempts.groupBy("report_id", "item_id", "attempt_no").agg(F.count("*").alias("n")).where("n > 1")


def gather_answers(attempts: DataFrame) -> DataFrame:
    """(report_id, answers): all attempts of a report in order of item, attempt and place."""
    place = F.col("pos") if "pos" in attempts.columns else F.xxhash64("verdict", "score", "confidence", "evidence", "error")
    one = F.struct(
        "item_id", "attempt_no", place.cast("bigint").alias("place"), "verdict", F.col("score").cast(SCORE).alias("score"),
        F.col("confidence").cast("double").alias("confidence"), F.coalesce("evidence", no_quotes()).alias("evidence"),
        _field(attempts, "error", ""), _field(attempts, "reason", ""), _field(attempts, "needs_review", False),
        _field(attempts, "tokens", 0), _field(attempts, "repaired", False))
    return attempts.groupBy("report_id").agg(F.array_sort(F.collect_list(one)).alias("answers"))


def verified(answers: Column, text: Column) -> Column:
    """Answers with tidy quotes, split into ``evidence`` and ``dropped_quotes``, and ``valid``; a miss carries no quotes."""
    def check(a: Column) -> Column:
        def split(quotes: Column) -> Column:
            return F.struct(F.filter(quotes, lambda q: is_traceable(q, text)).alias("good"), F.filter(quotes, lambda q: ~is_traceable(q, text)).alias("bad"))

        tidy = F.transform(a["evidence"], lambda q: tidy_quote(q, text))
        miss = F.coalesce(a["verdict"] == "miss", F.lit(False))
        return X.bind(X.bind(tidy, split), lambda s: a.withField("evidence", F.when(miss, no_quotes()).otherwise(s["good"])).withField(
            "dropped_quotes", F.when(miss, no_quotes()).otherwise(s["bad"])).withField("valid", miss | (F.size(s["good"]) > 0)))

    return F.transform(answers, check)


def resolved(answers: Column) -> Column:
    """One judgement per item from its verified first and second attempt, in order of item."""
    def attempt(item: Column, number: int) -> Column:
        return F.get(F.filter(answers, lambda a: (a["item_id"] == item) & (a["attempt_no"] == number)), F.lit(0))

    def choose(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        outcome = (F.when(a.isNull() | (a["error"] != ""), "system_error").when(a["valid"], "first")
                   .when(F.coalesce(b["error"], F.lit("")) != "", "system_error")
                   .when(F.coalesce(b["valid"], F.lit(False)), "second").otherwise("degraded"))
        return X.bind(outcome, lambda o: judgement(pair["item"], a, b, o))

    def judgement(item: Column, a: Column, b: Column, o: Column) -> Column:
        c, degraded = F.when(o == "first", a).when(o == "second", b), o == "degraded"
        error = F.when(a.isNull(), "no attempt").when(a["error"] != "", a["error"]).otherwise(b["error"])
        return F.struct(
            item.alias("item_id"), o.alias("outcome"), F.coalesce(c["verdict"], F.lit("miss")).alias("verdict"),
            F.coalesce(c["score"], F.lit(0)).cast(SCORE).alias("score"),
            F.coalesce(c["confidence"], F.when(degraded, a["confidence"]), F.lit(0.0)).alias("confidence"),
            F.coalesce(c["evidence"], no_quotes()).alias("evidence"),
            F.coalesce(c["dropped_quotes"], F.when(degraded, a["dropped_quotes"]), no_quotes()).alias("dropped_quotes"),
            F.coalesce(c["needs_review"], F.lit(True)).alias("needs_review"), F.when(o == "system_error", error).otherwise("").alias("system_error"),
            F.coalesce(c["reason"], F.when(degraded, a["reason"]), F.lit("")).alias("reason"), no_quotes().alias("review_reasons"))

    items = F.array_distinct(F.transform(answers, lambda a: a["item_id"]))
    return F.transform(items, lambda i: X.bind(F.struct(i.alias("item"), attempt(i, 1).alias("a"), attempt(i, 2).alias("b")), choose))


def judge_reports(texts: DataFrame, attempts: DataFrame) -> DataFrame:
    """(report_id, answers, the columns of ``texts``, judgements): the row that every function below reads.

    ``texts`` carries full_text, and sections where evidence is to be located.
    """
    rows = gather_answers(attempts).join(texts, "report_id", "left")
    rows = once(rows, "_verified", verified(F.col("answers"), F.coalesce("full_text", F.lit("")))).drop("answers").withColumnRenamed("_verified", "answers")
    return once(rows, "judgements", resolved(F.col("answers")))


def judgement_rows(judged: DataFrame) -> DataFrame:
    """The judgements as rows, one per report and item."""
    return judged.select("report_id", F.inline("judgements"))


def located(judged: DataFrame) -> DataFrame:
    """(report_id, item_id, section_id, quote, char_start) of every kept quote."""
    quotes = judged.select("report_id", "full_text", "sections", F.explode("judgements").alias("_j")).select(
        "report_id", "full_text", "sections", F.col("_j.item_id").alias("item_id"), F.explode("_j.evidence").alias("quote"))
    placed = quotes.withColumn("char_start", F.coalesce(X.find(F.col("full_text"), F.col("quote")), F.lit(-1)))
    return placed.select("report_id", "item_id", section_at(F.col("sections"), F.col("char_start")).alias("section_id"), "quote", "char_start")


def _flagged(condition, reason) -> Column:
    """Judgements with the review flag raised where ``condition(judgement)`` holds; a flag once set stays."""
    def one(j: Column) -> Column:
        def mark(hit: Column) -> Column:
            return j.withField("needs_review", j["needs_review"] | hit).withField(
                "review_reasons", F.when(hit, F.array_append(j["review_reasons"], reason(j))).otherwise(j["review_reasons"]))
        return X.bind(F.coalesce(condition(j), F.lit(False)), mark)

    return F.transform("judgements", one)


def with_injection_flags(judged: DataFrame, distance: int = K.INJECTION_DISTANCE) -> DataFrame:
    """Review when a kept quote lies close to a manipulation phrase; its place is looked for only where a phrase occurs."""
    text = F.col("full_text")
    rows = once(judged, "_labels", injection_labels(text))
    rows = once(rows, "_near", F.when(F.size("_labels") > 0, X.find(text, injection_snippet(text))))
    near = F.col("_near")

    def close(j: Column) -> Column:
        return (near >= 0) & F.exists(j["evidence"], lambda q: X.bind(X.find(text, q), lambda at: (at >= 0) & (F.abs(at - near) < distance)))

    return rows.withColumn("judgements", F.when(near >= 0, _flagged(close, lambda j: F.lit("evidence_near_manipulation"))).otherwise(
        F.col("judgements"))).drop("_labels", "_near")


def with_reuse_flags(judged: DataFrame) -> DataFrame:
    """Review items whose only quote is also the only quote of another non-miss item; ``shared_with`` lists them all."""
    def sole(j: Column) -> Column:
        return (j["verdict"] != "miss") & (F.size(j["evidence"]) == 1)

    def shared(j: Column, soles: Column) -> Column:
        return F.when(sole(j), F.array_sort(F.transform(F.filter(soles, lambda s: s["q"] == j["evidence"][0]), lambda s: s["item"])))

    def with_owners(soles: Column) -> Column:
        return F.transform("judgements", lambda j: X.bind(shared(j, soles), lambda own: j.withField(
            "shared_with", F.when(F.size(own) > 1, own).otherwise(no_quotes()))))

    soles = F.transform(F.filter("judgements", sole), lambda j: F.struct(j["item_id"].alias("item"), j["evidence"][0].alias("q")))
    rows = once(judged, "_owned", X.bind(soles, with_owners)).drop("judgements").withColumnRenamed("_owned", "judgements")
    return rows.withColumn("judgements", _flagged(
        lambda j: F.size(j["shared_with"]) > 1, lambda j: F.concat(F.lit("same_sole_evidence:"), F.array_join(j["shared_with"], ","))))


def with_recall_flags(judged: DataFrame, coverage: Column) -> DataFrame:
    """A miss found on recalled text only may be a miss of the recall: review it."""
    return judged.withColumn("judgements", _flagged(
        lambda j: F.col("full_text").isNotNull() & (coverage == "retrieved") & (j["verdict"] == "miss") & (j["system_error"] == ""), lambda j: F.lit("miss_on_recalled_text")))


def totals(judged: DataFrame) -> DataFrame:
    """(report_id, total, total_incomplete, system_errors), summed on the row."""
    failed = F.size(F.filter("judgements", lambda j: j["system_error"] != ""))
    total = F.aggregate("judgements", F.lit(0).cast("decimal(19,2)"), lambda s, j: (s + j["score"]).cast("decimal(19,2)"))
    return judged.select("report_id", F.bround(total, 1).alias("total"), (failed > 0).alias("total_incomplete"), failed.cast("bigint").alias("system_errors"))


def run_info(judged: DataFrame) -> DataFrame:
    """(report_id, calls, tokens, failed_calls, json_repaired, system_errors, chars, report_hash) of the row's answers and text."""
    def count(column: str, keep) -> Column:
        return F.size(F.filter(column, keep)).cast("bigint")

    return judged.select(
        "report_id", F.size("answers").cast("bigint").alias("calls"),
        F.aggregate("answers", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"].cast("bigint")).alias("tokens"),
        count("answers", lambda a: a["error"] != "").alias("failed_calls"), count("answers", lambda a: a["repaired"]).alias("json_repaired"),
        count("judgements", lambda j: j["system_error"] != "").alias("system_errors"),
        F.length("full_text").alias("chars"), F.left(F.sha2("full_text", 256), F.lit(16)).alias("report_hash"))


def quote_rates(texts: DataFrame, attempts: DataFrame) -> DataFrame:
    """(report_id, quote_rate): share of all quotes as given that are long enough and occur verbatim; no quotes, no row."""
    rows = gather_answers(attempts).join(texts.select("report_id", "full_text"), "report_id", "left")
    quotes = once(rows, "_quotes", F.flatten(F.transform("answers", lambda a: a["evidence"]))).where(F.size("_quotes") > 0)
    good = F.filter("_quotes", lambda q: (F.length(q) >= K.QUOTE_MIN_LEN) & F.contains("full_text", q))
    return quotes.select("report_id", ratio(F.size(good), F.size("_quotes")).alias("quote_rate"))
