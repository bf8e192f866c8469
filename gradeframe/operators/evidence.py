"""Evidence: verbatim quote checks, validity of judgements, locations, reuse and nearby manipulation.

A quote meets its own report only: equi join on report_id, then ``contains``. Judgement rows keep
their quotes as an array, so one join serves all quotes of a row and nothing is regrouped.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.rows import once
from .sections import injection_labels, injection_snippet, section_at

KEY = ["report_id", "item_id"]


def no_quotes() -> Column:
    return F.array().cast("array<string>")


def is_traceable(quote: Column, text: Column) -> Column:
    """The one rule for kept evidence: length inside the window and verbatim in the text."""
    return F.length(quote).between(K.QUOTE_MIN_LEN, K.QUOTE_MAX_LEN) & F.contains(text, quote)


def tidy_quote(quote: Column, text: Column) -> Column:
    """The quote as it stands in the text, else in canonical form.

    A quote cut out of a canonical text need not be canonical itself: `A A A A in` ends as `A A A A i`, which looks letter-spaced.
    """
    return X.bind(X.canonical_ws(F.coalesce(quote, F.lit(""))),
                  lambda q: F.when(is_traceable(q, text), q).otherwise(X.collapse_char_spacing(q)))


def with_texts(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Attach the report's text (and other text-side columns) by an equi join; unknown reports get NULL."""
    return rows.join(texts.select("report_id", *(columns or ("full_text",))), "report_id", "left")


def verify_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes as they stand in the text, else in canonical form, with ``kept``."""
    text = F.coalesce("full_text", F.lit(""))
    tidy = once(with_texts(quotes, texts), "_quote", tidy_quote(F.col("quote"), text)).withColumn("quote", F.col("_quote"))
    return tidy.withColumn("kept", is_traceable(F.col("quote"), text)).drop("full_text", "_quote")


def verify_judgements(judgements: DataFrame, texts: DataFrame) -> DataFrame:
    """Split evidence into kept and dropped quotes and decide ``valid``.

    A miss is always valid and carries no evidence; anything else needs at least one kept quote.
    """
    text = F.coalesce("full_text", F.lit(""))
    quotes = F.transform(F.coalesce("evidence", no_quotes()), lambda q: tidy_quote(q, text))
    miss = F.col("verdict") == "miss"
    checked = once(with_texts(judgements, texts), "_quotes", quotes).withColumn(
        "_good", F.filter("_quotes", lambda q: is_traceable(q, text))).withColumn(
        "_bad", F.filter("_quotes", lambda q: ~is_traceable(q, text)))
    return checked.withColumns({
        "evidence": F.when(miss, no_quotes()).otherwise(F.col("_good")),
        "dropped_quotes": F.when(miss, no_quotes()).otherwise(F.col("_bad")),
        "valid": miss | (F.size("_good") > 0),
    }).drop("full_text", "_quotes", "_good", "_bad")


def attach_locations(judgements: DataFrame, parsed: DataFrame) -> DataFrame:
    """``evidence`` becomes array<struct<section_id, quote, char_start>>; kept quotes only."""
    joined = with_texts(judgements, parsed, "full_text", "sections")

    def place(q: Column) -> Column:
        def inside(at: Column) -> Column:
            return F.struct(section_at(F.col("sections"), at).alias("section_id"), q.alias("quote"), at.alias("char_start"))
        return X.bind(F.coalesce(X.find(F.col("full_text"), q), F.lit(-1)), inside)

    return joined.withColumn("evidence", F.transform("evidence", place)).drop("full_text", "sections")


def add_reason(condition: Column, reason: Column | str) -> Column:
    """``review_reasons`` with one more entry when the condition holds."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(condition, F.array_append("review_reasons", reason)).otherwise(F.col("review_reasons"))


def flag(judgements: DataFrame, condition: Column, reason: Column | str) -> DataFrame:
    """Monotone review flag: once set it stays, every rule adds its reason."""
    if "review_reasons" not in judgements.columns:
        judgements = judgements.withColumn("review_reasons", no_quotes())
    hit = F.coalesce(condition, F.lit(False))
    return judgements.withColumns({"review_reasons": add_reason(hit, reason),
                                   "needs_review": F.col("needs_review") | hit})


def flag_injection(judgements: DataFrame, texts: DataFrame, distance: int = K.INJECTION_DISTANCE) -> DataFrame:
    """Review when a kept quote lies close to a manipulation phrase of the same report.

    Only reports with such a phrase take part in the join.
    """
    text = F.col("full_text")
    suspicious = (once(texts.select("report_id", "full_text"), "_labels", injection_labels(text)).where(F.size("_labels") > 0)
                  .select("report_id", "full_text", injection_snippet(text).alias("_snippet"))
                  .select("report_id", "full_text", X.find(F.col("full_text"), F.col("_snippet")).alias("_near")))
    joined = judgements.join(suspicious, "report_id", "left")

    def close(q: Column) -> Column:
        at = X.find(F.col("full_text"), q)
        return (at >= 0) & (F.abs(at - F.col("_near")) < distance)

    near = (F.col("_near") >= 0) & F.exists("evidence", close)
    return flag(joined, near, "evidence_near_manipulation").drop("full_text", "_near")


def flag_reused_evidence(judgements: DataFrame) -> DataFrame:
    """Review every item whose only quote is also the only quote of another non-miss item of the report."""
    sole = judgements.where((F.col("verdict") != "miss") & (F.size("evidence") == 1)).select(
        *KEY, F.col("evidence")[0].alias("_quote"))
    # at most one entry per rubric item
    owners = sole.groupBy("report_id", "_quote").agg(F.array_sort(F.collect_set("item_id")).alias("shared_with"))
    shared = owners.where(F.size("shared_with") > 1).select(
        "report_id", F.explode("shared_with").alias("item_id"), "shared_with")
    joined = judgements.join(shared, KEY, "left")
    return flag(joined, F.col("shared_with").isNotNull(),
                F.concat(F.lit("same_sole_evidence:"), F.array_join("shared_with", ","))).withColumn(
        "shared_with", F.coalesce("shared_with", no_quotes()))


def flag_recall_miss(judgements: DataFrame, inspected: DataFrame) -> DataFrame:
    """A miss found on recalled text only may be a miss of the recall: review it."""
    partly_read = inspected.where(F.col("coverage") == "retrieved").select("report_id", F.lit(True).alias("_partly"))
    joined = judgements.join(partly_read, "report_id", "left")
    doubtful = F.col("_partly") & (F.col("verdict") == "miss") & (F.coalesce("system_error", F.lit("")) == "")
    return flag(joined, doubtful, "miss_on_recalled_text").drop("_partly")
