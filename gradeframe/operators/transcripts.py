"""Page transcripts made by an outside reader: triage, normalising, page text, enrichment, statistics, pending work.

pages(report_id, page_no, text, images array<struct<kind, caption, content>>, legible, notes, error, cached)
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X

IMAGES = "array<struct<kind:string,caption:string,content:string>>"


def vision_triage(reports: DataFrame) -> DataFrame:
    """(report_id, needed, mode, reasons, text_chars, has_shot_word, has_code).

    ``reports`` may carry warnings (array of text) and embedded_images. Without code or output in the
    text its pages must be transcribed, with code it is enough to describe the images.
    """
    have = reports.columns
    warnings = F.coalesce("warnings", F.array().cast("array<string>")) if "warnings" in have else F.array().cast("array<string>")
    images = F.coalesce("embedded_images", F.lit(0)) if "embedded_images" in have else F.lit(0)
    text = F.coalesce("full_text", F.lit(""))
    base = reports.select(
        "report_id", F.length(X.strip(text)).alias("text_chars"),
        text.rlike(X.unicode_regex(K.SCREENSHOT_WORDS)).alias("has_shot_word"),
        text.rlike(X.unicode_regex(K.CODE_MARKERS)).alias("has_code"), images.alias("embedded_images"),
        F.exists(warnings, lambda w: X.contains_any(w, X.words(K.SCAN_WARNING_WORDS))).alias("scan_like"))
    code = F.col("has_code")
    reasons = F.array_compact(F.array(
        F.when(F.col("scan_like"), "parser_warning"),
        F.when(F.col("has_shot_word") & ~code, "screenshots_without_code"),
        F.when((F.col("embedded_images") > 0) & code, "images_beside_code"),
        F.when((F.col("embedded_images") > 0) & ~code, "images"),
        F.when((F.col("text_chars") < K.THIN_TEXT_CHARS) & ~code, "thin_text")))
    out = base.withColumn("reasons", reasons).withColumn("needed", F.size("reasons") > 0)
    mode = F.when(~F.col("needed"), "").when(code & ~F.col("scan_like"), "caption").otherwise("transcribe")
    return out.withColumn("mode", mode)


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Trimmed texts, lower-case image kinds, unknown kinds become other."""

    def image(i: Column) -> Column:
        def tidy(kind: Column) -> Column:
            return F.struct(F.when(kind.isin(*K.IMAGE_KINDS), kind).otherwise("other").alias("kind"),
                            X.strip(F.coalesce(i["caption"], F.lit(""))).alias("caption"),
                            X.strip(F.coalesce(i["content"], F.lit(""))).alias("content"))
        return X.bind(F.lower(X.strip(F.coalesce(i["kind"], F.lit("other")))), tidy)

    return pages.withColumns({
        "text": X.strip(F.coalesce("text", F.lit(""))),
        "images": F.transform(F.coalesce("images", F.array().cast(IMAGES)), image),
        "legible": F.coalesce("legible", F.lit(True)),
        "notes": X.strip(F.coalesce("notes", F.lit(""))),
        "error": F.coalesce("error", F.lit("")),
    })


def page_block(page_no: Column, text: Column, images: Column, notes: Column) -> Column:
    """One page as text: a heading the section cut recognises, a blank line, the text, image lines, notes."""
    kinds = F.create_map(*[F.lit(v) for pair in K.IMAGE_KINDS.items() for v in pair])

    def image_line(i: Column) -> Column:
        head = F.rtrim(F.concat(F.lit("["), F.coalesce(F.try_element_at(kinds, i["kind"]), F.lit("图片")), F.lit("] "),
                                X.strip(F.coalesce(i["caption"], F.lit("")))))
        content = X.strip(F.coalesce(i["content"], F.lit("")))
        return F.when(content == "", head).otherwise(F.concat(head, F.lit("："), content))

    body, note = X.strip(F.coalesce(text, F.lit(""))), X.strip(F.coalesce(notes, F.lit("")))
    pictures = F.coalesce(images, F.array().cast(IMAGES))
    lines = F.concat(
        F.array(F.concat(F.lit("第 "), page_no.cast("string"), F.lit(" 页 OCR 转录")), F.lit("")),
        F.when(body != "", F.array(body)).when(F.size(pictures) == 0, F.array(F.lit(K.EMPTY_PAGE_TEXT)))
        .otherwise(F.array().cast("array<string>")),
        F.transform(pictures, image_line),
        F.when(note != "", F.array(F.concat(F.lit("（转录说明："), note, F.lit("）")))).otherwise(F.array().cast("array<string>")))
    return F.array_join(lines, "\n")


def page_text(pages: DataFrame) -> DataFrame:
    """(report_id, transcript): all pages of a report in page order.

    The transcript of a report is one text by definition, as large as the report's own pages.
    """
    blocks = pages.select("report_id", "page_no", page_block(
        F.col("page_no"), F.col("text"), F.col("images"), F.col("notes")).alias("block"))
    gathered = blocks.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "block"))).alias("_b"))
    joined = F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n")
    return gathered.select("report_id", F.concat(F.lit(K.TRANSCRIPT_HEAD + "\n"), joined, F.lit("\n")).alias("transcript"))


def enrich_reports(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """The report text first, its transcript after it; ``added_chars`` tells how much came in."""
    joined = reports.join(page_text(pages), "report_id", "left")
    own = F.coalesce("raw_text", F.lit(""))
    enriched = F.when(F.col("transcript").isNull(), own).otherwise(
        F.concat(F.rtrim(own, F.lit(X.WS_CHARS)), F.lit("\n\n"), F.col("transcript")))
    return joined.withColumn("_own", F.length(own)).withColumn("raw_text", enriched).withColumn(
        "added_chars", F.length("raw_text") - F.col("_own")).drop("transcript", "_own")


def page_stats(pages: DataFrame) -> DataFrame:
    """(report_id, pages_read, cached_hits, chars, images, failed)."""
    return pages.groupBy("report_id").agg(
        F.count("*").alias("pages_read"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached_hits"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
        F.sum(F.size(F.coalesce("images", F.array().cast(IMAGES)))).alias("images"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"))


def page_key(digest: Column, page_no: Column, dpi: Column, model: Column, prompt_version: Column, mode: Column) -> Column:
    """Key of one reading: any change of file, page, resolution, model, prompt or mode makes a new one."""
    return F.left(F.sha2(F.concat_ws("_", digest, page_no.cast("string"), dpi.cast("string"), model, prompt_version, mode), 256),
                  F.lit(32))


def pending_pages(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages without a stored reading under exactly their key."""
    keyed = wanted.withColumn("page_key", page_key(*[F.col(c) for c in (
        "digest", "page_no", "dpi", "model", "prompt_version", "mode")]))
    return keyed.join(cache.select("page_key"), "page_key", "left_anti")


def compare_runs(before: DataFrame, after: DataFrame, expected: list[str]) -> DataFrame:
    """(report_id, item_id, score and quote count before and after, expected strings that now appear).

    ``before`` and ``after`` are judgement tables with evidence arrays.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("report_id", "item_id", F.col("score").alias(f"score_{tag}"),
                         F.size("evidence").alias(f"quotes_{tag}"), F.col("evidence").alias(f"evidence_{tag}"))
    j = side(before, "before").join(side(after, "after"), ["report_id", "item_id"], "full")
    blob = F.array_join(F.coalesce("evidence_after", F.array().cast("array<string>")), "\n")
    return j.select("report_id", "item_id", "score_before", "score_after",
                    F.coalesce("quotes_before", F.lit(0)).alias("quotes_before"),
                    F.coalesce("quotes_after", F.lit(0)).alias("quotes_after"),
                    X.contained(X.words(expected), blob).alias("found"))
