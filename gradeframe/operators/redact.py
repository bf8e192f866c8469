"""Redaction, hygiene scans, clipping for publication and publication gates. Row-local except the quote join."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.numbering import running_ids
from ..functions.rows import once

_PII = tuple((label, X.unicode_regex(p), to, K.PII_ANCHORS.get(label, ())) for label, p, to in K.PII_PATTERNS)
_HYGIENE = tuple((label, X.unicode_regex(p)) for label, p in K.HYGIENE_PATTERNS)
_SECRET = X.unicode_regex(K.SECRET_SHAPE)


def _count(text: Column, pattern: str, anchors: Sequence[str]) -> Column:
    return F.when(X.has_anchor(text, anchors), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def looks_private(text: Column, label: str, pattern: str) -> Column:
    """Whether a personal-data pattern occurs, with its cheap anchor first."""
    return X.has_anchor(text, K.PII_ANCHORS.get(label, ())) & text.rlike(X.unicode_regex(pattern))


def squeeze(c: Column) -> Column:
    """3 and more blanks become 2, 4 and more line breaks become 3."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t]{3,}", "  "), "\n{4,}", "\n\n\n")


def redact(df: DataFrame, text: str = "raw_text", names: Sequence[str] = ()) -> DataFrame:
    """Replace personal data pattern by pattern; each pattern sees the output of the one before.

    Adds ``redacted`` and ``hits`` (label -> count, labels without a hit are left out; known names
    are only counted, never listed).
    """
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    counters = []
    for i, (label, pattern, to, anchors) in enumerate(_PII):
        out = out.withColumn(f"_n{i}", _count(F.col("_t"), pattern, anchors))
        out = out.withColumn("_t", F.when(F.col(f"_n{i}") > 0, F.regexp_replace("_t", pattern, to)).otherwise(F.col("_t")))
        counters.append((label, f"_n{i}"))
    out = out.withColumns(dict(zip(("_t", "_names"), _names_replaced(F.col("_t"), names))))
    counters.append(("known_names", "_names"))
    entries = F.filter(F.array(*[F.struct(F.lit(label).alias("key"), F.col(c).cast("int").alias("value"))
                                 for label, c in counters]), lambda e: e["value"] > 0)
    return out.withColumns({"redacted": X.strip(squeeze(F.col("_t"))), "hits": F.map_from_entries(entries)}).drop(
        "_t", *[c for _, c in counters])


def _names_replaced(text: Column, names: Sequence[str]) -> tuple[Column, Column]:
    count = F.lit(0)
    for name in names:
        without = F.replace(text, F.lit(name), F.lit(""))
        count = count + ((F.length(text) - F.length(without)) / len(name)).cast("int")
        text = F.replace(text, F.lit(name), F.lit(K.NAME_PLACEHOLDER))
    return text, count


def redact_names(df: DataFrame, names: Sequence[str], text: str = "raw_text") -> DataFrame:
    """Replace names known from a local list; adds ``redacted`` and ``name_hits``."""
    clean, count = _names_replaced(F.col(text), names)
    return df.withColumns({"redacted": clean, "name_hits": count})


def residual_pii(df: DataFrame, text: str = "redacted") -> DataFrame:
    """(report_id, checker, n): what still looks like personal data; own placeholders do not count."""
    counts = F.array(*[F.struct(F.lit(label).alias("checker"), _count(
        F.col(text), X.unicode_regex(p), K.PII_ANCHORS.get(label, ())).alias("n")) for label, p in K.RESIDUAL_CHECKERS])
    return df.select("report_id", F.inline_outer(counts)).where("n > 0")


def residual_findings(text: Column) -> Column:
    """Label -> count of what still looks like personal data; empty when nothing does."""
    counts = F.array(*[F.struct(F.lit(label).alias("key"), _count(text, X.unicode_regex(p), K.PII_ANCHORS.get(label, ())).cast("int").alias("value"))
                       for label, p in K.RESIDUAL_CHECKERS])
    return F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))


def _report_length(least: int) -> tuple[Column, Column]:
    text = F.coalesce("raw_text", F.lit(""))
    return F.length(text), F.length(X.strip(text)) >= least


def rejected_reports(reports: DataFrame, least: int = K.MIN_CORPUS_CHARS) -> DataFrame:
    """(report_id, original, chars, reason) of the texts that ``anonymize_corpus`` leaves out; a missing text has 0 characters."""
    chars, long_enough = _report_length(least)
    return reports.where(~long_enough).select("report_id", _original(reports), chars.alias("chars"), F.lit("too_short").alias("reason"))


def _original(reports: DataFrame) -> Column:
    """What the report was called: the file's name without folders, else ``name``, else the id."""
    file = [F.nullif(F.regexp_extract("path", r"([^/\\]*)$", 1), F.lit(""))] if "path" in reports.columns else []
    name = [F.col("name")] if "name" in reports.columns else []
    return F.coalesce(*file, *name, F.col("report_id").cast("string")).alias("original")


def anonymize_corpus(reports: DataFrame, names: Sequence[str] = (), least: int = K.MIN_CORPUS_CHARS) -> DataFrame:
    """Redact all texts that are long enough to be reports and give them running anonymous ids in the order of ``report_id``.

    (report_id, anonymous_id, original, chars, hits, residual, redacted); ``residual`` counts what still looks like personal
    data after redaction. Ids of any type will do. ``rejected_reports`` lists the others.
    """
    _, long_enough = _report_length(least)
    kept = reports.where(long_enough)
    # ids are assigned on the narrow key column; texts meet them again by key
    ids = running_ids(kept.select("report_id"), "report_id")
    tag = F.concat(F.lit("S"), F.when(F.col("running_id") < 100, F.lpad(F.col("running_id").cast("string"), 2, "0"))
                   .otherwise(F.col("running_id").cast("string"))).alias("anonymous_id")
    clean = redact(kept.withColumn("_original", _original(reports)), "raw_text", names).join(ids.select("report_id", tag), "report_id")
    return clean.select("report_id", "anonymous_id", F.col("_original").alias("original"), F.length("redacted").alias("chars"), "hits",
                        residual_findings(F.col("redacted")).alias("residual"), "redacted")


def hygiene_scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, type, line, snippet): first real hit of each type per file; placeholders and templates are passed over."""
    name = F.lower(F.col(path))
    skip = F.lit(False)
    for suffix in K.BINARY_SUFFIXES:
        skip = skip | F.endswith(name, F.lit(suffix))
    for suffix in K.TEMPLATE_SUFFIXES:
        skip = skip | F.endswith(F.col(path), F.lit(suffix))

    def first_hit(label: str, pattern: str) -> Column:
        def locate(p: Column) -> Column:
            def at(k: Column) -> Column:
                before = F.concat(F.array_join(F.slice(p["gaps"], 1, k), ""), F.array_join(F.slice(p["hits"], 1, k - 1), ""))
                breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
                return F.when(k > 0, F.struct(F.lit(label).alias("type"), (breaks + 1).alias("line"),
                                              F.left(F.get(p["hits"], k - 1), F.lit(40)).alias("snippet")))
            real = F.transform(p["hits"], lambda h: ~h.rlike(K.HYGIENE_PLACEHOLDER))
            return X.bind(F.array_position(real, F.lit(True)).cast("int"), at)

        found = X.bind(F.struct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"),
                                F.split(F.col(text), pattern, -1).alias("gaps")), locate)
        return F.when(F.col(text).rlike(pattern), found)

    hits = F.array_compact(F.array(*[first_hit(label, p) for label, p in _HYGIENE]))
    return files.where(~skip).select(path, F.inline_outer(hits)).where("type is not null")


def mask_secrets(c: Column, secrets: Sequence[str] = ()) -> Column:
    """Known secrets keep 3 characters, anything shaped like a key keeps only its prefix."""
    out = F.coalesce(c, F.lit(""))
    for s in secrets:
        if s and len(s) >= 6:
            out = F.replace(out, F.lit(s), F.lit(s[:3] + "*" * 8))
    return F.regexp_replace(out, _SECRET, "$1-" + "*" * 8)


def merge_intervals(spans: Column) -> Column:
    """Sorted array<struct<a, b>> -> merged overlapping or touching intervals, still sorted."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when((F.size(acc) > 0) & (s["a"] <= last["b"]),
                      F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.array_append(acc, s))

    return F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), step)


def evidence_spans(text: Column, quotes: Column, window: int = K.CLIP_WINDOW) -> Column:
    """Merged intervals around every located quote of one text, as array work on the row."""
    placed = F.transform(F.array_distinct(F.filter(quotes, lambda q: F.length(q) >= K.QUOTE_MIN_LEN)), lambda q: F.struct(
        X.find(text, q).alias("pos"), F.length(q).alias("len")))
    spans = F.transform(F.filter(placed, lambda p: p["pos"] >= 0), lambda p: F.struct(
        F.greatest(p["pos"] - window, F.lit(0)).cast("int").alias("a"), F.least(p["pos"] + p["len"] + window, F.length(text)).cast("int").alias("b")))
    return X.bind(F.array_sort(spans), merge_intervals)


def evidence_windows(texts: DataFrame, quotes: DataFrame, window: int = K.CLIP_WINDOW) -> DataFrame:
    """(report_id, full_text, spans): merged intervals around every located quote, per report; NULL without quotes.

    The distinct quotes of a report meet its text once. They are those of its judged items, so the rubric bounds their number.
    """
    gathered = quotes.select("report_id", "quote").distinct().groupBy("report_id").agg(F.collect_list("quote").alias("_q"))
    return once(texts.join(gathered, "report_id", "left"), "spans", evidence_spans(F.col("full_text"), F.col("_q"), window)).drop("_q")


def clip_public_text(texts: DataFrame, quotes: DataFrame, window: int = K.CLIP_WINDOW,
                     budget: int = K.CLIP_BUDGET) -> DataFrame:
    """(report_id, public_text, is_public): evidence windows under a total budget; without evidence, the head."""
    found = evidence_windows(texts, quotes, window)

    def step(acc: Column, s: Column) -> Column:
        room = F.lit(budget) - acc["used"]
        chunk = X.piece(F.col("full_text"), s["a"], F.least(s["b"] - s["a"], room))
        part = F.concat(F.when(s["a"] > 0, "……").otherwise(""), chunk, F.lit("……"))
        return F.when(room <= 0, acc).otherwise(F.struct(
            (acc["used"] + F.length(chunk)).cast("int").alias("used"), F.array_append(acc["parts"], part).alias("parts")))

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))
    clipped = F.aggregate("spans", zero, step, lambda acc: F.array_join(acc["parts"], "\n\n"))
    head = F.concat(F.left("full_text", F.lit(budget)), F.lit("\n\n……（未命中任何证据片段，仅展示报告开头）"))
    return found.select("report_id", F.when(F.size("spans") > 0, clipped).otherwise(head).alias("public_text"),
                        F.lit(True).alias("is_public"))


def check_public(cases: DataFrame, cap: int = K.PUBLIC_CAP) -> DataFrame:
    """(report_id, problem) for everything that must not be published; any row blocks the write."""
    text = F.coalesce("public_text", F.lit(""))
    problems = [F.when(~F.coalesce("is_public", F.lit(False)), "not_marked_public"),
                F.when(F.length(text) > cap, "over_size_cap")]
    problems += [F.when(looks_private(text, label, p), label) for label, p in K.PUBLIC_CHECKERS]
    return cases.select("report_id", F.explode_outer(F.array_compact(F.array(*problems))).alias("problem")).where(
        "problem is not null")


def safe_name(c: Column, fallback: str = "未命名报告") -> Column:
    """Letters, digits, CJK, underscore and hyphen only; trimmed, at most 60 characters, never empty."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z一-鿿_\-]+", "")
    short = F.left(F.btrim(kept, F.lit("-_")), F.lit(60))
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(fallback))
