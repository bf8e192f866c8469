"""Text preparation: headings, sections, offsets, inspection, recall, context, quote location.

A report is one row, so sectioning is written with array functions over its lines: no shuffle,
and the work of a task is bounded by the report itself.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.rows import once

SECTION = "struct<id:string,title:string,level:int,text:string,char_start:int,char_end:int>"
_HEADING = "|".join(f"(?:{X.unicode_regex(p)})" for p in K.HEADING_PATTERNS)


def is_heading(line: Column, next_line: Column) -> Column:
    """Short line without clause punctuation that matches a pattern or whose successor looks like a body."""

    def decide(pair: Column) -> Column:
        s, nxt = pair["s"], pair["nxt"]
        looks = (F.endswith(s, F.lit("：")) | (nxt == "")
                 | (F.length(nxt) > F.length(s) * F.lit(1.6)) | pair["line"].rlike(_HEADING))
        return (F.length(s).between(2, K.HEADING_MAX_CHARS)
                & ~X.ends_with_any(s, K.NOT_A_HEADING_END) & looks)

    return X.bind(F.struct(line.alias("line"), X.strip(line).alias("s"),
                           X.strip(F.coalesce(next_line, F.lit(""))).alias("nxt")), decide)


def heading_level(title: Column) -> Column:
    """1-3 from the numeric prefix."""
    return (F.when(title.rlike(X.unicode_regex(r"^\s*\(?\d+(\.\d+){2}")), 3)
            .when(title.rlike(X.unicode_regex(r"^\s*\(?\d+(\.\d+)")), 2)
            .otherwise(1))


def _section(id_, title, level, text, start, end) -> Column:
    return F.struct(id_.alias("id"), title.alias("title"), level.cast("int").alias("level"), text.alias("text"),
                    start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))


def _numbered(prefix: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(suffix))


def chunk_array(text: Column, size: int = K.CHUNK_SIZE) -> Column:
    """Fixed-size pieces as a section array; empty for empty text."""
    before, after = K.CHUNK_TITLE.split("{n}")

    def one(start: Column, i: Column) -> Column:
        body = X.piece(text, start, F.lit(size))
        return _section(_numbered("s", i), _numbered(before, i, after), F.lit(1), body, start, start + F.length(body))

    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    return F.coalesce(F.transform(starts, one), F.array().cast(f"array<{SECTION}>"))


def _raw_sections(lines: Column, heads: Column) -> Column:
    """Preface (when long enough) and one section per heading, ids counted over that list."""

    def body(first: Column, last: Column) -> Column:
        return X.strip(F.array_join(F.slice(lines, first + 1, last - first), "\n"))

    first_head = heads[0]
    preface = X.bind(body(F.lit(0), first_head), lambda p: F.when(
        (first_head > 0) & (F.length(p) >= K.MIN_SECTION_CHARS),
        F.array(F.struct(F.lit(K.PREFACE_TITLE).alias("title"), F.lit(1).alias("level"), p.alias("text"))),
    ).otherwise(F.array().cast("array<struct<title:string,level:int,text:string>>")))

    def from_head(h: Column, i: Column) -> Column:
        title = X.strip(F.get(lines, h))
        end = F.coalesce(F.get(heads, i + 1), F.size(lines))
        return F.struct(F.left(title, F.lit(K.TITLE_MAX_CHARS)).alias("title"),
                        heading_level(title).alias("level"), body(h, end).alias("text"))

    return F.concat(preface, F.transform(heads, from_head))


def _merge_short(raw: Column) -> Column:
    """A section shorter than the minimum joins the one before it; the first always stands."""
    starts = F.filter(F.sequence(F.lit(0), F.size(raw) - 1),
                      lambda i: (i == 0) | (F.length(F.get(raw, i)["text"]) >= K.MIN_SECTION_CHARS))

    def island(starts_: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts_, j + 1), F.size(raw))
            text = F.array_join(F.transform(F.slice(raw, s + 1, end - s), lambda x: x["text"]), "\n")
            head = F.get(raw, s)
            return F.struct(_numbered("s", s).alias("id"), head["title"].alias("title"),
                            head["level"].alias("level"), text.alias("text"))
        return F.transform(starts_, one)

    return X.bind(starts, island)


def locate_in_order(text: Column, sections: Column) -> Column:
    """Start and end of each section text in ``text``; never decreasing, unknown texts take the running position."""

    def step(acc: Column, s: Column) -> Column:
        start = X.bind(X.find_from(text, s["text"], acc["pos"]), lambda hit: F.when(
            (F.length(s["text"]) > 0) & (hit >= 0), hit).otherwise(acc["pos"]))
        return X.bind(start, lambda at: F.struct(
            (at + F.length(s["text"])).cast("int").alias("pos"),
            F.array_append(acc["starts"], at.cast("int")).alias("starts")))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))
    return X.bind(F.aggregate(sections, zero, step, lambda acc: acc["starts"]), lambda at: F.transform(
        sections, lambda s, i: _section(s["id"], s["title"], s["level"], s["text"],
                                        F.get(at, i), F.get(at, i) + F.length(s["text"]))))


def _by_headings(text: Column, chunks: Column, merged: Callable[[Column], Column]) -> Column:
    """``chunks`` for a text with fewer than two headings, else ``merged`` of the sections that the headings cut."""
    def from_lines(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                         lambda i: is_heading(F.get(lines, i), F.get(lines, i + 1)))
        return X.bind(heads, lambda hs: F.when(F.size(hs) < 2, chunks).otherwise(
            X.bind(X.bind(_raw_sections(lines, hs), _merge_short), merged)))

    return X.bind(F.split(text, "\n", -1), from_lines)


def section_array(text: Column, chunk_size: int = K.CHUNK_SIZE) -> Column:
    """All sections of one raw text, with offsets into it."""
    return _by_headings(text, chunk_array(text, chunk_size), lambda m: locate_in_order(text, m))


def cut_sections(text: Column, chunk_size: int = K.CHUNK_SIZE) -> Column:
    """The same sections without offsets, for callers that do not need them or that locate another form of the texts."""
    return _by_headings(text, F.transform(chunk_array(text, chunk_size), lambda s: s.dropFields("char_start", "char_end")), lambda m: m)


def cut_reports(reports: DataFrame) -> DataFrame:
    """``raw_text`` with plain line breaks and ``sections`` as cut from it, neither canonical nor located: what line rules read."""
    others = [c for c in reports.columns if c not in ("raw_text", "sections")]
    rows = once(reports.select(*others, "raw_text"), "_raw", X.normalize_newlines(F.col("raw_text"))).select(*others, F.col("_raw").alias("raw_text"))
    return once(rows, "sections", cut_sections(F.col("raw_text")))


def explode_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """One row per section, numbered from 0 in order.

    The outer form keeps the planner from testing the array in a filter first, which would build it twice.
    """
    keep = [c for c in df.columns if c != sections]
    return (df.select(*keep, F.posexplode_outer(sections).alias("section_ord", "_s")).where("section_ord is not null")
            .select(*keep, "section_ord", F.col("_s.id").alias("section_id"), "_s.title", "_s.level", "_s.text",
                    "_s.char_start", "_s.char_end"))


def split_sections(reports: DataFrame, text: str = "raw_text") -> DataFrame:
    """Section rows of every report: (report_id, section_ord, section_id, title, level, text, offsets)."""
    return explode_sections(reports.select("report_id", section_array(F.col(text)).alias("sections")))


def section_offsets(reports: DataFrame, text: str = "raw_text") -> DataFrame:
    """Offsets only; the texts are dropped as soon as they are located."""
    return split_sections(reports, text).select("report_id", "section_ord", "section_id", "char_start", "char_end")


def chunk_text(reports: DataFrame, size: int = K.CHUNK_SIZE, text: str = "raw_text") -> DataFrame:
    return explode_sections(reports.select("report_id", chunk_array(F.col(text), size).alias("sections")))


def parse_reports(reports: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Split on the raw lines, then bring text and sections to canonical form with offsets into it."""
    others = [c for c in reports.columns if c not in ("raw_text", "full_text", "sections")]

    def both(raw: Column) -> Column:
        def located(full: Column) -> Column:
            clean = F.transform(cut_sections(raw), lambda s: F.struct(
                s["id"].alias("id"), s["title"].alias("title"), s["level"].alias("level"),
                X.canonical(s["text"]).alias("text")))
            return F.struct(raw.alias("raw"), full.alias("full"),
                            X.bind(clean, lambda ss: locate_in_order(full, ss)).alias("sections"))
        return X.bind(X.canonical(raw), located)

    parsed = X.bind(X.normalize_newlines(F.col("raw_text")), both)
    out = once(reports, "_p", parsed).select(
        *others, F.col("_p.raw").alias("raw_text"), F.col("_p.full").alias("full_text"), "_p.sections")
    return out if keep_raw else out.drop("raw_text")


def coverage_of(chars: Column, limit: int = K.FULL_TEXT_LIMIT) -> Column:
    return F.when(chars == 0, "empty").when(chars <= limit, "full").otherwise("retrieved")


def inspect_reports(parsed: DataFrame, limit: int = K.FULL_TEXT_LIMIT) -> DataFrame:
    """(report_id, chars, sections, coverage, warnings); a missing text counts as empty."""
    n = F.coalesce(F.length("full_text"), F.lit(0))
    cut = F.coalesce(F.size("sections"), F.lit(0))
    base = parsed.select("report_id", n.alias("chars"), F.greatest(cut, F.lit(0)).alias("n_sections"))
    c, s = F.col("chars"), F.col("n_sections")
    warnings = F.array_compact(F.array(
        F.when(c == 0, "no_text"),
        F.when((c > 0) & (c < K.SHORT_TEXT_CHARS), "short_text"),
        F.when(c > limit, "over_limit"),
        F.when((s == 0) & (c > 0), "no_sections")))
    return base.select("report_id", "chars", "n_sections", coverage_of(c, limit).alias("coverage"),
                       warnings.alias("warnings"))


def recall_array(sections: Column, keywords: Column, k: int) -> Column:
    """Top-k sections by distinct keywords contained, ties by shorter text, then by order.

    Without keywords, or when none is contained anywhere, the first k sections.
    """
    usable = F.array_distinct(keywords)
    scored = F.transform(sections, lambda s, i: F.struct(
        (-F.size(X.contained(usable, s["text"]))).alias("minus_hits"), F.length(s["text"]).alias("len"),
        i.alias("ord")))
    ranked = F.filter(F.slice(F.array_sort(scored), 1, k), lambda r: r["minus_hits"] < 0)
    return X.bind(ranked, lambda r: F.when(
        F.size(r) > 0, F.transform(r, lambda x: x["ord"])).otherwise(
        F.transform(F.slice(sections, 1, k), lambda s, i: i)))


def recall_sections(parsed: DataFrame, rubric: DataFrame, k: int = K.RECALL_TOP_K) -> DataFrame:
    """(report_id, item_id, rank, section_ord, section_id) for every rubric item; reports carry ``rubric_id``."""
    picked = with_rubric(parsed, rubric).select(
        "report_id", "sections", F.explode("items").alias("item"))
    picked = picked.select("report_id", F.col("item.item_id").alias("item_id"), "sections",
                           F.posexplode_outer(recall_array(F.col("sections"), F.col("item.positive_signals"), k))
                           .alias("rank", "section_ord"))
    return picked.where("rank is not null").select("report_id", "item_id", (F.col("rank") + 1).alias("rank"), "section_ord",
                         F.get("sections", F.col("section_ord"))["id"].alias("section_id"))


def build_context(parsed: DataFrame, rubric: DataFrame, k: int = K.RECALL_TOP_K,
                  per_section: int = K.RECALL_SECTION_CHARS, limit: int = K.FULL_TEXT_LIMIT) -> DataFrame:
    """The text a judge sees per report and item: everything when it fits, else the recalled sections.

    ``limit``, ``k`` and ``per_section`` are the published bounds; ``truncated`` says whether anything of the report is missing
    from the context and ``left_out`` how many of its sections are. A report without a rubric has one row without an item.
    """
    rows = with_rubric(parsed, rubric).select("report_id", "full_text", "sections", F.explode_outer("items").alias("item"))
    fits = F.length("full_text") <= limit
    signals = F.coalesce(F.col("item.positive_signals"), F.array().cast("array<string>"))

    def part(o: Column) -> Column:
        s = F.get(F.col("sections"), o)
        return F.concat(F.lit("["), s["id"], F.lit("] "), s["title"], F.lit("\n"),
                        F.left(s["text"], F.lit(per_section)))

    chosen = once(rows, "_chosen", F.when(~fits, recall_array(F.col("sections"), signals, k)))
    recalled = F.array_join(F.transform("_chosen", part), "\n\n")
    left_out = F.when(fits, 0).otherwise(F.size("sections") - F.size("_chosen"))
    cut = F.exists("_chosen", lambda o: F.length(F.get(F.col("sections"), o)["text"]) > per_section)
    return chosen.select("report_id", F.col("item.item_id").alias("item_id"), fits.alias("is_full"),
                         F.when(fits, F.col("full_text")).otherwise(recalled).alias("context"),
                         (~fits & ((left_out > 0) | F.coalesce(cut, F.lit(False)))).alias("truncated"), left_out.alias("left_out"))


def with_rubric(reports: DataFrame, rubric: DataFrame) -> DataFrame:
    """Attach each report's rubric as an array of all its items, by rubric_id; NULL where there is no such rubric.

    No item is cut here: ``normalize_rubrics`` is the one place that shortens a rubric, by rank and with new maxima.
    """
    nested = (rubric.groupBy("rubric_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "ord", "item_id", "name", "criteria", F.col("max_score").cast("decimal(9,2)").alias("max_score"),
            "positive_signals", "negative_signals"))).alias("items")))
    return reports.join(nested, "rubric_id", "left")


def locate_quotes(quotes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Add char_start (0-based, -1 when absent) and the first section that holds it ('' when none)."""
    joined = quotes.join(parsed.select("report_id", "full_text", "sections"), "report_id", "left")
    pos = F.coalesce(X.find(F.col("full_text"), F.col("quote")), F.lit(-1))
    joined = joined.withColumn("char_start", pos)
    return joined.withColumn("section_id", section_at(F.col("sections"), F.col("char_start"))).drop("full_text", "sections")


def section_at(sections: Column, position: Column) -> Column:
    """Id of the first section that holds a position; '' when none does."""
    return X.bind(position, lambda at: F.coalesce(F.get(F.filter(
        sections, lambda s: (s["char_start"] <= at) & (at < s["char_end"])), F.lit(0))["id"], F.lit("")))


_INJECTION = tuple(
    (r"(?iUd)" + p, label, anchors) for (p, label), anchors in zip(K.INJECTION_PATTERNS, K.INJECTION_ANCHORS))


def injection_labels(text: Column) -> Column:
    """Labels of the manipulation patterns found; a pattern runs only where one of its anchors occurs."""
    return X.bind(X.fold_case(text), lambda folded: F.array_compact(F.array(*[
        F.when(X.has_anchor(folded, anchors) & text.rlike(p), label) for p, label, anchors in _INJECTION])))


def injection_snippet(text: Column) -> Column:
    """Text around the first hit of the first pattern found; meant for the few texts that have one."""
    snippet = F.lit("")
    for pattern, _, _ in reversed(_INJECTION):
        at = F.regexp_instr(text, F.lit(pattern)) - 1
        hit = F.regexp_extract(text, pattern, 0)
        start = F.greatest(at - K.INJECTION_SNIPPET_PAD, F.lit(0))
        around = X.piece(text, start, at + F.length(hit) + K.INJECTION_SNIPPET_PAD - start)
        snippet = F.when(text.rlike(pattern), around).otherwise(snippet)
    return snippet


def detect_injection(parsed: DataFrame) -> DataFrame:
    """(report_id, labels, snippet) for reports with at least one manipulation phrase."""
    text = F.col("full_text")
    found = once(parsed.select("report_id", "full_text"), "labels", injection_labels(text)).where(F.size("labels") > 0)
    return found.select("report_id", "labels", injection_snippet(text).alias("snippet"))
