"""Report health check: discipline profile, slots, eight rule items, totals, summaries and version diffs.

The rule items read one report row and write one array of items: no shuffle, no vocabulary join.
A report row needs ``raw_text`` (with its lines), ``sections`` and ``profile``.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.numbers import clamp, ratio
from ..functions.rows import first_row, literal_table, once

RULE_ITEMS = [k for k, (_, e) in K.CHECK_ITEMS.items() if e == "rule"]
AI_ITEMS = [k for k, (_, e) in K.CHECK_ITEMS.items() if e == "ai"]
ISSUE = "struct<problem:string,location:string,impact:string,direction:string>"
_SLOT = {name: i for i, name in enumerate(K.SECTION_SLOTS)}
_RX = X.unicode_regex


def check_catalog(spark: SparkSession) -> DataFrame:
    """The twelve items with weight and engine (weights add up to 100)."""
    rows = [(i, name, w, e) for i, (name, (w, e)) in enumerate(K.CHECK_ITEMS.items(), 1)]
    return literal_table(spark, "item_ord int, item string, weight int, item_engine string", rows)


def pick_profile(experiment_type: Column) -> Column:
    """Discipline words first, then computing words, else the general profile."""
    kind = F.lower(F.coalesce(experiment_type, F.lit("")))
    out = F.lit(K.GENERAL)
    for profile, hints in reversed(K.DISCIPLINE_HINTS):
        out = F.when(X.contains_any(kind, X.words(hints)), profile).otherwise(out)
    return out


def vocabulary(profile: Column) -> Column:
    """Words of the eight slots of a profile; unknown profiles use the general one. A folded literal."""
    table = F.from_json(F.lit(json.dumps(K.PROFILE_KEYWORDS, ensure_ascii=False)), "map<string,array<array<string>>>")
    return F.coalesce(F.try_element_at(table, profile), F.try_element_at(table, F.lit(K.GENERAL)))


def keyword_index(text: Column, sections: Column, words: Column, by_line: bool = True) -> Column:
    """Where each word first occurs: the lines of the text, (w, at) of words in short lines and (w, at) of words in titles.

    Most words occur nowhere, which one search of the whole text tells; only the others are looked for line by line, and
    not at all without ``by_line``.
    """
    def places(words_: Column, texts: Column) -> Column:
        first = F.transform(words_, lambda w: F.struct(w.alias("w"), F.get(F.filter(texts, lambda c: F.contains(c["s"], w)), F.lit(0))["i"].alias("at")))
        return F.filter(first, lambda e: e["at"].isNotNull())

    titles = F.transform(sections, lambda s, i: F.struct(i.alias("i"), s["title"].alias("s")))
    # titles are short: one search of all of them together leaves few words to look for title by title
    joined = F.array_join(F.transform(sections, lambda s: s["title"]), "\n")
    in_titles = X.bind(joined, lambda all_: F.filter(words, lambda w: F.contains(all_, w)))
    title_at = X.bind(F.struct(titles.alias("ts"), in_titles.alias("ws")), lambda p: places(p["ws"], p["ts"])).alias("title_at")
    if not by_line:
        return F.struct(title_at)

    def of_lines(lines: Column) -> Column:
        short = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), X.strip(line).alias("s"))),
                         lambda c: F.length(c["s"]).between(2, K.HEADING_MAX_CHARS))
        return X.bind(F.struct(short.alias("short"), F.filter(words, lambda w: F.contains(text, w)).alias("there")), lambda p: F.struct(
            lines.alias("lines"), places(p["there"], p["short"]).alias("line_at"), title_at))

    return X.bind(X.lines_of(text), of_lines)


def _first_at(places: Column, keywords: Column) -> Column:
    return F.array_min(F.transform(F.filter(places, lambda e: F.array_contains(keywords, e["w"])), lambda e: e["at"]))


def _section_body(s: Column) -> Column:
    """Canonical text of a section without its own title; only sections that fill a slot come here."""
    def without_title(p: Column) -> Column:
        own = (p["title"] != "") & F.startswith(p["text"], p["title"])
        return F.when(own, X.strip(F.substring(p["text"], F.length(p["title"]) + 1, F.length(p["text"])))).otherwise(p["text"])

    return X.bind(F.struct(X.strip(s["title"]).alias("title"), X.strip(X.canonical(s["text"])).alias("text")), without_title)


def _body_after(lines: Column, at: Column, stop_words: Column, most_lines: int, most_chars: int) -> Column:
    """(body, cut): text below a heading line up to a line that looks like another heading, within the limits.

    The end is found first and the lines are sliced once; ``cut`` says that a limit ended the body while lines were left.
    """
    window = F.transform(F.slice(lines, at + 2, most_lines), lambda line, i: F.struct(line.alias("line"), X.strip(line).alias("cur"), i.alias("i")))

    def step(acc: Column, l: Column) -> Column:
        cur = l["cur"]
        heading = F.length(cur).between(2, K.HEADING_MAX_CHARS) & ~X.ends_with_any(cur, K.LINE_HEADING_BAD_END)
        stop = heading & (acc["any"] | X.contains_any(cur, stop_words))
        used = acc["used"] + F.length(cur)
        return F.when(acc["end"] >= 0, acc).when(stop, acc.withField("end", l["i"])).otherwise(F.struct(
            used.cast("int").alias("used"), (acc["any"] | (cur != "")).alias("any"),
            F.when(used >= most_chars, l["i"] + 1).otherwise(-1).cast("int").alias("end"), (used >= most_chars).alias("full")))

    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("any"), F.lit(-1).alias("end"), F.lit(False).alias("full"))

    def body(window_: Column) -> Column:
        def upto(acc: Column) -> Column:
            end = F.when(acc["end"] >= 0, acc["end"]).otherwise(F.size(window_))
            kept = F.transform(F.slice(window_, F.lit(1), end), lambda l: F.when(l["cur"] == "", "").otherwise(l["line"]))
            return F.struct(F.array_join(kept, "\n").alias("body"),
                            ((acc["full"] | (acc["end"] < 0)) & (at + 1 + end < F.size(lines))).alias("cut"))
        return X.bind(F.aggregate(window_, zero, step), upto)

    return X.bind(window, body)


def slots_from(index: Column, sections: Column, vocab: Column, by_line: bool = True, most_lines: int = K.SLOT_LINES,
               most_chars: int = K.SLOT_CHARS) -> Column:
    """Eight (body, cut) in slot order, NULL where the report has no such part: the first section whose title holds a word of the
    slot, else the text below the first short line with one."""
    def fill(stop_words: Column) -> Column:
        def one(kw: Column) -> Column:
            titled = X.bind(_first_at(index["title_at"], kw), lambda at: F.when(at.isNotNull(), F.struct(
                _section_body(F.get(sections, at)).alias("body"), F.lit(False).alias("cut"))))
            if not by_line:
                return titled
            below = X.bind(_first_at(index["line_at"], kw), lambda at: F.when(
                at.isNotNull(), _body_after(index["lines"], at, stop_words, most_lines, most_chars)))
            return X.bind(titled, lambda t: F.when(t.isNotNull(), t).otherwise(below))
        return F.transform(vocab, one)

    if not by_line:
        return fill(F.array().cast("array<string>"))
    # a stop word ends a body only in a short line, so those that no short line holds need not be asked for
    there = F.transform(index["line_at"], lambda e: e["w"])
    return X.bind(F.filter(F.flatten(vocab), lambda w: F.array_contains(there, w)), fill)


def map_slots(reports: DataFrame, by_line: bool = True, most_lines: int = K.SLOT_LINES, most_chars: int = K.SLOT_CHARS) -> DataFrame:
    """Add ``slots``, eight bodies in slot order (NULL where the report has no such part), and ``slots_cut``: ended by a limit."""
    rows = once(reports, "_vocab", vocabulary(F.col("profile")))
    rows = once(rows, "_index", keyword_index(F.col("raw_text"), F.col("sections"), F.array_distinct(F.flatten("_vocab")), by_line))
    return _with_slots(rows, F.col("_vocab"), by_line, most_lines, most_chars).drop("_vocab", "_index")


def _with_slots(rows: DataFrame, vocab: Column, by_line: bool = True, most_lines: int = K.SLOT_LINES, most_chars: int = K.SLOT_CHARS) -> DataFrame:
    rows = once(rows, "_slots", slots_from(F.col("_index"), F.col("sections"), vocab, by_line, most_lines, most_chars))
    return rows.withColumns({"slots": F.transform("_slots", lambda s: s["body"]),
                             "slots_cut": F.transform("_slots", lambda s: F.coalesce(s["cut"], F.lit(False)))}).drop("_slots")


def slot_rows(mapped: DataFrame) -> DataFrame:
    """(report_id, slot, body, cut) for the slots found."""
    named = F.zip_with(F.arrays_zip(X.words(K.SECTION_SLOTS).alias("slot"), F.col("slots").alias("body")), F.col("slots_cut"), lambda n, c: F.struct(
        n["slot"].alias("slot"), n["body"].alias("body"), c.alias("cut")))
    return mapped.select("report_id", F.inline_outer(named)).where("body is not null")


def _slot(name: str) -> Column:
    return F.coalesce(F.get("slots", F.lit(_SLOT[name])), F.lit(""))


def _line_of(lines: Column, word: str) -> Column:
    at = F.array_position(F.transform(lines, lambda line: F.contains(line, F.lit(word))), F.lit(True))
    return F.when(at > 0, F.concat(F.lit("line "), at.cast("string"))).otherwise("")


def _item(name: str, score: Column, status: Column, problem: Column, has_issue: Column,
          location: Column | None = None, impact: Column | str = "中", direction: str = "") -> Column:
    impact = F.lit(impact) if isinstance(impact, str) else impact
    issue = F.struct(problem.alias("problem"), (location if location is not None else F.lit("")).alias("location"),
                     impact.alias("impact"), F.lit(direction[:K.MAX_DIRECTION_LEN]).alias("direction"))
    return F.struct(F.lit(name).alias("item"), score.cast("double").alias("score"), status.alias("status"),
                    F.lit("rule").alias("engine"),
                    F.when(has_issue, F.array(issue)).otherwise(F.array().cast(f"array<{ISSUE}>")).alias("issues"))


def _graded(score: Column) -> Column:
    return F.when(score == 100, K.PASSED).when(score > 0, K.WEAK).otherwise(K.MISSING)


def _say(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def check_structure() -> Column:
    """Share of the eight slots that were found."""
    n = F.size(F.filter("slots", lambda s: s.isNotNull()))
    share = n / F.lit(len(K.SECTION_SLOTS))
    absent = F.filter(F.zip_with(X.words(K.SECTION_SLOTS), F.col("slots"), lambda name, b: F.when(b.isNull(), name)),
                      lambda name: name.isNotNull())
    status = F.when(share >= 0.8, K.PASSED).when(share >= 0.5, K.WEAK).otherwise(K.MISSING)
    return _item("结构与完整性", F.bround(share * 100), status,
                 F.concat(_say("%d/8 sections found; missing: ", n), F.array_join(absent, ",")), n < 8,
                 impact=F.when(share < 0.5, "较大").otherwise("中"), direction="add the missing section headings")


def check_purpose(lines: Column) -> Column:
    """80 characters are enough, 30 are a start."""
    n = F.length(X.strip(_slot("实验目的")))
    score = F.when(n >= 80, 100).when(n >= 30, 60).otherwise(0)
    return _item("实验目的", score, _graded(score), _say("purpose has %d characters", n), score < 100,
                 _line_of(lines, "目的"), F.when(score == 0, "较大").otherwise("中"), "say what, how and what to expect")


def _by_profile(text: Column, computing: str, other: str) -> Column:
    return F.when(F.col("profile") == K.COMPUTING, F.regexp_count(text, F.lit(_RX(computing)))).otherwise(
        F.regexp_count(text, F.lit(_RX(other))))


def check_steps(text: Column, lines: Column) -> Column:
    """Numbered lines and concrete parameters; what counts as concrete depends on the profile."""
    def decide(p: Column) -> Column:
        score = (F.when((p["s"] >= 3) & (p["p"] >= 3), 100).when((p["s"] >= 1) & (p["p"] >= 1), 65)
                 .when((p["s"] > 0) | (p["p"] > 0), 40).otherwise(0))
        return _item("步骤可复现性", score, _graded(score), _say("%d numbered lines, %d parameters", p["s"], p["p"]),
                     score < 100, direction="number the steps and give exact values")
    steps = F.size(F.filter(lines, lambda line: line.rlike(_RX(K.STEP_PATTERN))))
    params = _by_profile(text, K.COMPUTING_PARAM_PATTERN, K.UNIT_PATTERN)
    return X.bind(F.struct(steps.alias("s"), params.alias("p")), decide)


def check_data(text: Column, lines: Column) -> Column:
    """Raw data: run output for computing reports, marked tables with number rows for the others."""
    def output(p: Column) -> Column:
        n, rows, digits = p["n"], p["rows"], p["digits"]
        score = (F.when((n >= 80) | (digits >= 20) | (rows >= 6), 100)
                 .when((n >= 30) | (digits >= 5) | (rows >= 2), 70).when(n > 0, 25).otherwise(0))
        where = F.coalesce(F.nullif(_line_of(lines, "运行结果"), F.lit("")), _line_of(lines, "输出"))
        return _item("原始数据表", score, _graded(score), _say("output: %d characters, %d lines, %d digits", n, rows, digits),
                     score < 100, where, F.when(score == 0, "较大").otherwise("中"), "paste the real program output")

    def tables(p: Column) -> Column:
        score = (F.when((p["marks"] > 0) & (p["rows"] >= 3), 100)
                 .when((p["rows"] >= 1) | (p["marks"] > 0), 55).otherwise(0))
        return _item("原始数据表", score, _graded(score), _say("%d table marks, %d number rows", p["marks"], p["rows"]),
                     score < 100, impact=F.when(score == 0, "较大").otherwise("中"), direction="keep raw readings in a table")

    def measured(body: Column) -> Column:
        return F.struct(F.length(body).alias("n"),
                        F.size(F.filter(X.lines_of(body), lambda line: X.strip(line) != "")).alias("rows"),
                        F.regexp_count(body, F.lit(_RX(r"\d"))).alias("digits"))

    from_output = X.bind(X.bind(X.strip(_slot("原始数据表")), measured), output)
    from_tables = X.bind(F.struct(F.regexp_count(text, F.lit(_RX(K.TABLE_HINT_PATTERN))).alias("marks"),
                                  F.regexp_count(text, F.lit(_RX(K.DIGIT_ROW_PATTERN))).alias("rows")), tables)
    return F.when(F.col("profile") == K.COMPUTING, from_output).otherwise(from_tables)


def decimal_places(lines: Column) -> Column:
    """Distinct numbers of decimal places over the lines that hold at least two decimals."""
    dotted = F.filter(lines, lambda line: line.rlike(r"\.(?U:\d)"))       # cheap, and every such number has it
    numbers = F.transform(dotted, lambda line: F.regexp_extract_all(line, F.lit(_RX(K.NUMBER_PATTERN)), F.lit(1)))
    rows = F.filter(numbers, lambda ns: F.size(ns) >= 2)
    return F.array_sort(F.array_distinct(F.transform(
        F.flatten(rows), lambda n: F.length(F.substring_index(n, ".", -1)))))


def check_digits(lines: Column) -> Column:
    """More than two different precisions in the data rows are inconsistent."""
    def decide(places: Column) -> Column:
        mixed = F.size(places) > 2
        return _item("有效数字", F.when(mixed, 55).otherwise(100), F.when(mixed, K.WEAK).otherwise(K.PASSED),
                     F.concat(F.lit("decimal places: "), F.array_join(places.cast("array<string>"), ",")), mixed,
                     direction="use one precision per group of data")
    return X.bind(decimal_places(lines), decide)


def check_units(text: Column) -> Column:
    """Values with a unit; computing reports count quantified results instead."""
    def decide(n: Column) -> Column:
        score = F.when(n >= 5, 100).when(n >= 1, 60).otherwise(20)
        return _item("单位与量纲", score, F.when(score == 100, K.PASSED).otherwise(K.WEAK),
                     _say("%d values with units", n), score < 100, direction="give every value its unit")
    return X.bind(_by_profile(text, K.COMPUTING_QUANT_PATTERN, K.UNIT_PATTERN), decide)


def figure_counts(lines: Column) -> Column:
    """struct<figures, uncaptioned>: numbered figure marks and those without text after them on their line.

    A mark followed by another mark on its line has that as its text, so only the last one of a line can lack one.
    """
    def per_line(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(_RX(K.FIGURE_PATTERN)))
        rest = F.element_at(F.split(line, _RX(K.FIGURE_PATTERN), -1), -1)
        bare = F.length(X.strip(F.regexp_replace(rest, _RX(K.CAPTION_LEAD_PATTERN), ""))) < 2
        return F.struct(n.alias("figures"), F.when((n > 0) & bare, 1).otherwise(0).alias("uncaptioned"))

    marked = F.filter(lines, lambda line: X.has_anchor(line, K.FIGURE_ANCHORS) & line.rlike(_RX(K.FIGURE_PATTERN)))
    zero = F.struct(F.lit(0).alias("figures"), F.lit(0).alias("uncaptioned"))
    return F.aggregate(F.transform(marked, per_line), zero, lambda a, s: F.struct(
        (a["figures"] + s["figures"]).alias("figures"), (a["uncaptioned"] + s["uncaptioned"]).alias("uncaptioned")))


def check_figures(lines: Column) -> Column:
    """Figures need a number and a caption."""
    def decide(p: Column) -> Column:
        n, bare = p["figures"], p["uncaptioned"]
        score = F.when((n > 0) & (bare == 0), 100).when(n > 0, 50).otherwise(0)
        return _item("图表规范", score, _graded(score), _say("%d numbered figures, %d without caption", n, bare),
                     score < 100, direction="number each figure and give it a caption")
    return X.bind(figure_counts(lines), decide)


def check_references(text: Column) -> Column:
    """Numbered references, or links and titles."""
    def decide(p: Column) -> Column:
        score = (F.when((p["r"] >= 3) | ((p["r"] >= 1) & (p["c"] > 0)), 100)
                 .when((p["r"] > 0) | (p["c"] > 0), 60).otherwise(0))
        return _item("引用与格式", score, _graded(score), _say("%d numbered references, %d links or titles", p["r"], p["c"]),
                     score < 100, impact=F.when(score > 0, "较小").otherwise("中"), direction="state sources in one format")
    return X.bind(F.struct(F.regexp_count(text, F.lit(_RX(K.REFERENCE_PATTERN))).alias("r"),
                           F.regexp_count(text, F.lit(_RX(K.CITE_PATTERN))).alias("c")), decide)


def rule_items(mapped_text: Column) -> Column:
    """The eight rule items of one report as an array; a report without text gets eight missing items."""
    empty = F.array(*[_item(name, F.lit(0), F.lit(K.MISSING), F.lit("no text could be extracted"), F.lit(True))
                      for name in RULE_ITEMS])

    def from_lines(lines: Column) -> Column:
        return F.array(check_structure(), check_purpose(lines), check_steps(mapped_text, lines),
                       check_data(mapped_text, lines), check_digits(lines), check_units(mapped_text),
                       check_figures(lines), check_references(mapped_text))

    return F.when(X.strip(F.coalesce(mapped_text, F.lit(""))) == "", empty).otherwise(
        X.bind(X.lines_of(mapped_text), from_lines))


def rule_check(reports: DataFrame) -> DataFrame:
    """(report_id, profile, item, score, status, engine, issues): eight rows per report."""
    mapped = map_slots(reports)
    return mapped.select("report_id", "profile", rule_items(F.col("raw_text")).alias("_i")).select(
        "report_id", "profile", F.inline_outer("_i"))


def profile_matrix(reports: DataFrame) -> DataFrame:
    """(report_id, one total per profile, distinct_totals, tied): does the discipline change the outcome, and which are equal?

    What no profile changes is scored once per report: precision, figures and references, and the table, step and unit rules
    of all profiles but the computing one. Each profile then adds its slots, structure and purpose on the same row, the
    computing one also its own three rules. Nothing is multiplied or shuffled; totals are exact because all rule scores are integers.
    """
    text, blank = F.col("raw_text"), X.strip(F.coalesce("raw_text", F.lit(""))) == ""

    def scores(items: list[Column]) -> Column:
        return F.struct(*[i["score"].alias(f"s{k}") for k, i in enumerate(items)])

    def weighted(names: list[str], column: str) -> Column:
        return sum((F.col(column)[f"s{k}"] * K.CHECK_ITEMS[name][0] for k, name in enumerate(names)), F.lit(0.0))

    fixed, varied, own = ["有效数字", "图表规范", "引用与格式"], ["步骤可复现性", "原始数据表", "单位与量纲"], ["结构与完整性", "实验目的"]
    every = sum(K.CHECK_ITEMS[name][0] for name in RULE_ITEMS)
    rows = reports.drop("profile").withColumns({"profile": F.lit(K.GENERAL), "slots": F.array().cast("array<string>")})
    # one index of all words of all profiles; each profile only looks its own up
    every_word = sorted({w for slots in K.PROFILE_KEYWORDS.values() for words in slots for w in words})
    rows = once(rows, "_index", keyword_index(text, F.col("sections"), X.words(every_word)))
    lines = F.col("_index")["lines"]                     # cut once for all rules of all profiles
    rows = once(rows, "_fixed", scores([check_digits(lines), check_figures(lines), check_references(text)]))
    rows = once(rows, "_varied", scores([check_steps(text, lines), check_data(text, lines), check_units(text)]))
    totals = []
    for i, profile in enumerate(K.PROFILES, 1):
        rows = _with_slots(rows.drop("slots", "slots_cut").withColumn("profile", F.lit(profile)), vocabulary(F.lit(profile)))
        rows = once(rows, f"_own{i}", scores([check_structure(), check_purpose(lines)]))
        varied_here = "_varied"
        if profile == K.COMPUTING:
            varied_here = "_computing"
            rows = once(rows, varied_here, scores([check_steps(text, lines), check_data(text, lines), check_units(text)]))
        top = weighted(own, f"_own{i}") + weighted(varied, varied_here) + weighted(fixed, "_fixed")
        totals.append(F.when(blank, 0.0).otherwise(F.round(ratio(top, F.lit(every)), 1)).alias(f"p{i}"))
    each = rows.select("report_id", *totals)
    scored = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"p{i}").alias("total")) for i, name in enumerate(K.PROFILES, 1)])
    distinct = F.array_distinct(F.array(*[f"p{i}" for i in range(1, len(K.PROFILES) + 1)]))
    tied = F.filter(F.transform(distinct, lambda t: F.transform(F.filter(scored, lambda p: p["total"] == t), lambda p: p["name"])), lambda g: F.size(g) > 1)
    return each.withColumns({"distinct_totals": F.size(distinct).cast("long"), "tied": tied})


# ---- model items, totals, comparisons ----------------------------------------------
def sanitize_checks(payload: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Model items held to the catalogue: unknown names dropped, absent ones untested, values clamped.

    ``payload(check_id, item, score, status, issues, seq)``; the last entry of an item counts.
    """
    checks = (payload if checks is None else checks).select("check_id").distinct()
    wanted = checks.select("check_id", F.explode_outer(X.words(AI_ITEMS)).alias("item"))
    last = first_row(payload.where(F.col("item").isin(*AI_ITEMS)), ["check_id", "item"], [F.desc("seq")])
    j = wanted.join(last, ["check_id", "item"], "left")
    present = F.col("seq").isNotNull()

    def tidy(i: Column) -> Column:
        direction = X.strip(F.coalesce(i["direction"], F.lit("")))
        short = F.when(F.length(direction) <= K.MAX_DIRECTION_LEN, direction).otherwise(
            F.concat(F.left(direction, F.lit(K.MAX_DIRECTION_LEN - 1)), F.lit("…")))
        impact = F.when(i["impact"].isin(*K.IMPACTS), i["impact"]).otherwise("中")
        return F.struct(F.coalesce(i["problem"], F.lit("")).alias("problem"),
                        F.coalesce(i["location"], F.lit("")).alias("location"), impact.alias("impact"),
                        short.alias("direction"))

    silent = F.array(F.struct(F.lit("no answer for this item").alias("problem"), F.lit("").alias("location"),
                              F.lit("较小").alias("impact"), F.lit("").alias("direction")))
    return j.select(
        "check_id", "item",
        F.when(present, clamp(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), 0.0, 100.0)).otherwise(0.0).alias("score"),
        F.when(~present, K.UNTESTED).when(F.col("status").isin(K.PASSED, K.WEAK, K.MISSING), F.col("status"))
        .otherwise(K.WEAK).alias("status"), F.lit("ai").alias("engine"),
        F.when(present, F.transform(F.slice(F.coalesce("issues", F.array().cast(f"array<{ISSUE}>")), 1, K.MAX_ISSUES_PER_ITEM), tidy))
        .otherwise(silent).alias("issues"))


def _weighed(items: DataFrame) -> DataFrame:
    return items.join(check_catalog(items.sparkSession), "item", "left").withColumns(
        {"weight": F.coalesce("weight", F.lit(0)), "tested": F.col("status") != K.UNTESTED})


def check_total(items: DataFrame) -> DataFrame:
    """(check_id, total): weighted score over tested items only, 0 when nothing was tested."""
    weight = F.when(F.col("tested"), F.col("weight"))
    return _weighed(items).groupBy("check_id").agg(F.coalesce(
        ratio(F.sum(weight * F.col("score")), F.sum(weight)), F.lit(0.0)).alias("total"))


def check_summary(items: DataFrame) -> DataFrame:
    """(check_id, tested, passed, weak, tested_weight, untested): the untested list holds at most twelve names."""
    untested = F.collect_set(F.when(~F.col("tested"), F.col("item")))
    return _weighed(items).groupBy("check_id").agg(
        F.count_if("tested").alias("tested"), F.count_if(F.col("status") == K.PASSED).alias("passed"),
        F.count_if(F.col("status").isin(K.WEAK, K.MISSING)).alias("weak"),
        F.coalesce(F.sum(F.when(F.col("tested"), F.col("weight"))), F.lit(0)).alias("tested_weight"),
        F.array_sort(untested).alias("untested"))


def rank_issues(items: DataFrame) -> DataFrame:
    """Missing items before weak ones, heavier first (at most twelve rows per check)."""
    weak = _weighed(items.where(F.col("status").isin(K.WEAK, K.MISSING)))
    order = Window.partitionBy("check_id").orderBy(
        F.when(F.col("status") == K.MISSING, 0).otherwise(1), F.desc("weight"), "item_ord")
    return weak.withColumn("rank", F.row_number().over(order)).select("check_id", "rank", "item", "status", "weight")


def checklist(items: DataFrame) -> DataFrame:
    """All twelve items per check; what was not run is untested."""
    wanted = items.select("check_id").distinct().select("check_id", F.explode_outer(X.words(list(K.CHECK_ITEMS))).alias("item"))
    full = wanted.join(items.select("check_id", "item", "score", "status"), ["check_id", "item"], "left")
    return full.join(check_catalog(items.sparkSession), "item").select(
        "check_id", "item_ord", "item", "weight", F.col("item_engine").alias("engine"),
        F.coalesce("status", F.lit(K.UNTESTED)).alias("status"), F.coalesce(F.floor("score").cast("int"), F.lit(0)).alias("score"))


def diff_checks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Item by item against the version before: delta and mark, largest gain first when ordered by gain."""
    before = old.select("check_id", "item", F.col("score").alias("old_score"), F.col("status").alias("old_status"))
    j = new.select("check_id", "item", "score", "status").join(before, ["check_id", "item"], "left")
    had = F.col("old_status").isNotNull()
    delta = F.bround(F.col("score") - F.coalesce("old_score", F.lit(0)), 1)
    mark = (F.when(had & (F.col("old_status") != K.PASSED) & (F.col("status") == K.PASSED), "fixed")
            .when(had & (F.col("old_status") == K.UNTESTED) & (F.col("status") != K.UNTESTED), "newly_tested")
            .when(delta > 0, "better").when(delta == 0, "same").otherwise("worse"))
    gain = F.floor("score").cast("int") - F.coalesce(F.floor("old_score").cast("int"), F.lit(0))
    return j.select("check_id", "item", "old_score", "score", delta.alias("delta"), mark.alias("mark"), "status",
                    gain.alias("gain"))
