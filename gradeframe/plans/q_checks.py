"""Health check, history and page transcript queries."""

import re

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.rows import literal_table
from ..operators import checks as C
from ..operators import classview as CV
from ..operators import history as H
from ..operators import sections as S
from ..operators import transcripts as O
from .catalog import query
from .fixtures import CHECKS, DETAILS, FIRST, HISTORY, ITEM_MAX, LAB, canonical_cte, with_
from .q_text import LINES, SECTIONS, WS, located

NW = r"[^\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """The look-ahead `not followed by a word character` as a consumed character."""
    return pattern.replace(r"(?![\w])", f"(?:{NW}|$)").replace("'", "''")


LAB_LINES = LINES.replace("FROM documents)", "FROM lab)")
LAB_CANON = canonical_cte("ptexts", "(SELECT * RENAME (text AS raw_text) FROM sections)",
                          "report_id, section_ord, section_id, title, level") + """,
psections AS (SELECT * RENAME (full_text AS text) FROM ptexts)"""
VOCAB = "vocab(slot_ord, slot, ws) AS (VALUES " + ", ".join(
    f"({i}, '{slot}', {list(w)!r})" for i, (slot, w) in enumerate(zip(K.SECTION_SLOTS, K.PROFILE_KEYWORDS[K.GENERAL]))) + ")"
SLOTS = f"""hits AS (
  SELECT s.report_id, v.slot_ord, v.slot, s.section_ord, trim(s.title, {WS}) AS title, trim(s.text, {WS}) AS body
  FROM psections s JOIN vocab v ON len(list_filter(v.ws, lambda w: contains(s.title, w))) > 0
  QUALIFY row_number() OVER (PARTITION BY s.report_id, v.slot ORDER BY s.section_ord) = 1),
slots AS (
  SELECT report_id, slot_ord, slot, CASE WHEN title <> '' AND starts_with(body, title)
         THEN trim(substr(body, length(title) + 1), {WS}) ELSE body END AS body FROM hits)"""
MAPPED = with_(LAB, LAB_LINES, SECTIONS, LAB_CANON, VOCAB, SLOTS)


def _mapped(t):
    return C.map_slots(t.lab, by_line=False)


def _lab_item(t, name, item, slots=False):
    """(report_id, score, status, problem) of one rule item over the lab reports; only items that may read slots have them mapped."""
    return (_mapped(t) if slots else t.lab_lines).select("report_id", item.alias("i")).select(
        "report_id", "i.score", "i.status", F.coalesce(F.get("i.issues", F.lit(0))["problem"], F.lit("")).alias("problem"))


def _lines():
    return X.lines_of(F.col("raw_text"))


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


TYPE_LIST = ("Java lab", "有机化学实验", "大学物理", "生物信息学 python", "general lab")
PICK = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(kind), '{h}')" for h in hints) + f" THEN '{profile}'"
    for profile, hints in K.DISCIPLINE_HINTS) + f" ELSE '{K.GENERAL}' END"


@query("k1_pick_profile", f"""
SELECT report_id, kind, {PICK} AS profile FROM (
  SELECT doc_id AS report_id, {list(TYPE_LIST)!r}[doc_id % 5 + 1] || ' ' || lang AS kind FROM documents)""")
def k1(t):
    kind = F.concat(X.words(TYPE_LIST)[F.pmod("report_id", F.lit(5)).cast("int")], F.lit(" "), "course")
    return t.reports.select("report_id", kind.alias("kind")).withColumn("profile", C.pick_profile(F.col("kind")))


@query("k2_map_slots", MAPPED + "SELECT report_id, slot, body FROM slots")
def k2(t):
    return C.slot_rows(_mapped(t)).drop("cut")


_AND = f"PARTITION BY c.report_id, c.slot ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND"
ALL_WORDS = [w for words in K.PROFILE_KEYWORDS[K.GENERAL] for w in words]
# slots that no title gave: the first short line with a word, then the lines below it up to the next heading
BY_LINE = MAPPED.rstrip() + f""",
cut_lines AS (SELECT doc_id AS report_id, string_split(text, chr(10)) AS x FROM lab),
text_lines AS (SELECT report_id, i, x[i] AS line, trim(x[i], {WS}) AS s FROM (
  SELECT report_id, x, unnest(range(1, len(x) + 1 - CAST(x[len(x)] = '' AS INTEGER))) AS i FROM cut_lines)),
cand AS (
  SELECT l.report_id, v.slot_ord, v.slot, min(l.i) AS at FROM text_lines l JOIN vocab v
    ON length(l.s) BETWEEN 2 AND {K.HEADING_MAX_CHARS} AND len(list_filter(v.ws, lambda w: contains(l.s, w))) > 0
  WHERE NOT EXISTS (SELECT 1 FROM slots t WHERE t.report_id = l.report_id AND t.slot = v.slot) GROUP BY 1, 2, 3),
below AS (
  SELECT c.report_id, c.slot, l.i, CASE WHEN l.s = '' THEN '' ELSE l.line END AS line,
         (length(l.s) BETWEEN 2 AND {K.HEADING_MAX_CHARS} AND NOT contains('{K.LINE_HEADING_BAD_END}', right(l.s, 1))
          AND (coalesce(max(CAST(l.s <> '' AS INTEGER)) OVER ({_AND} 1 PRECEDING), 0) = 1
               OR len(list_filter({ALL_WORDS!r}, lambda w: contains(l.s, w))) > 0))
         OR coalesce(sum(length(l.s)) OVER ({_AND} 1 PRECEDING), 0) >= 2000 AS ends
  FROM cand c JOIN text_lines l ON l.report_id = c.report_id AND l.i > c.at AND l.i <= c.at + 40),
above_end AS (
  SELECT * FROM (SELECT *, bool_or(ends) OVER (PARTITION BY report_id, slot ORDER BY i) AS over_ FROM below) WHERE NOT over_),
slot_bodies AS (SELECT report_id, slot, string_agg(line, chr(10) ORDER BY i) AS body FROM above_end GROUP BY 1, 2),
every_slot AS (
  SELECT report_id, slot, body FROM slots UNION ALL
  SELECT c.report_id, c.slot, coalesce(b.body, '') FROM cand c LEFT JOIN slot_bodies b ON b.report_id = c.report_id AND b.slot = c.slot)
"""


@query("k3_map_slots_by_line", BY_LINE + "SELECT report_id, slot, body FROM every_slot")
def k3(t):
    return C.slot_rows(C.map_slots(t.lab)).drop("cut")


@query("k4_check_structure", MAPPED + """
SELECT d.doc_id AS report_id, round_even(coalesce(n, 0) / 8 * 100, 0) AS score,
       CASE WHEN coalesce(n, 0) >= 7 THEN '通过' WHEN coalesce(n, 0) >= 4 THEN '偏弱' ELSE '缺失' END AS status
FROM documents d LEFT JOIN (SELECT report_id, count(*) AS n FROM slots GROUP BY 1) s ON s.report_id = d.doc_id""")
def k4(t):
    return _lab_item(t, "结构与完整性", C.check_structure(), slots=True).drop("problem")


@query("k5_check_purpose", MAPPED + """
SELECT d.doc_id AS report_id, CAST(CASE WHEN coalesce(n, 0) >= 80 THEN 100 WHEN coalesce(n, 0) >= 30 THEN 60 ELSE 0 END AS DOUBLE) AS score,
       CASE WHEN coalesce(n, 0) >= 80 THEN '' ELSE 'purpose has ' || coalesce(n, 0) || ' characters' END AS problem
FROM documents d LEFT JOIN (SELECT report_id, length(body) AS n FROM slots WHERE slot = '实验目的') s ON s.report_id = d.doc_id""")
def k5(t):
    return _lab_item(t, "实验目的", C.check_purpose(_lines()), slots=True).drop("status")


LINE_SQL = "ls AS (SELECT doc_id AS report_id, text, unnest(string_split(text, chr(10))) AS line FROM lab)"
STEP_RE = K.STEP_PATTERN.replace("'", "''")


@query("k6_check_steps", with_(LAB, LINE_SQL, rf"""counts AS (
  SELECT report_id, count(*) FILTER (regexp_matches(line, '{STEP_RE}')) AS s,
         len(regexp_extract_all(any_value(text), '{re2(K.UNIT_PATTERN)}')) AS p FROM ls GROUP BY report_id)""") + """
SELECT report_id, CAST(CASE WHEN s >= 3 AND p >= 3 THEN 100 WHEN s >= 1 AND p >= 1 THEN 65 WHEN s > 0 OR p > 0 THEN 40 ELSE 0 END AS DOUBLE) AS score,
       CASE WHEN s >= 3 AND p >= 3 THEN '' ELSE s || ' numbered lines, ' || p || ' parameters' END AS problem FROM counts""")
def k6(t):
    return _lab_item(t, "步骤可复现性", C.check_steps(F.col("raw_text"), _lines())).drop("status")


@query("k7_check_data", with_(LAB, rf"""counts AS (
  SELECT doc_id AS report_id, len(regexp_extract_all(text, '{K.TABLE_HINT_PATTERN}')) AS m,
         len(regexp_extract_all(text, '\d+[\s\t,，]+\d+')) AS r FROM lab)""") + """
SELECT report_id, CAST(CASE WHEN m > 0 AND r >= 3 THEN 100 WHEN r >= 1 OR m > 0 THEN 55 ELSE 0 END AS DOUBLE) AS score,
       CASE WHEN m > 0 AND r >= 3 THEN '' ELSE m || ' table marks, ' || r || ' number rows' END AS problem FROM counts""")
def k7(t):
    return _lab_item(t, "原始数据表", C.check_data(F.col("raw_text"), _lines()), slots=True).drop("status")


@query("k7_check_output", MAPPED.rstrip() + rf""",
body AS (
  SELECT d.doc_id AS report_id, coalesce(s.body, '') AS b FROM documents d
  LEFT JOIN (SELECT report_id, body FROM slots WHERE slot = '原始数据表') s ON s.report_id = d.doc_id),
m AS (
  SELECT report_id, length(b) AS n, len(regexp_extract_all(b, '\d')) AS digits,
         CASE WHEN b = '' THEN 0 ELSE len(list_filter(string_split(b, chr(10)), lambda l: trim(l, {WS}) <> '')) END AS rows_ FROM body)
SELECT report_id, CAST(CASE WHEN n >= 80 OR digits >= 20 OR rows_ >= 6 THEN 100
         WHEN n >= 30 OR digits >= 5 OR rows_ >= 2 THEN 70 WHEN n > 0 THEN 25 ELSE 0 END AS DOUBLE) AS score FROM m""")
def k7b(t):
    # slots by the general words, judged by the computing rule
    mapped = _mapped(t).withColumn("profile", F.lit(K.COMPUTING))
    return mapped.select("report_id", C.check_data(F.col("raw_text"), _lines())["score"].alias("score"))


@query("k8_check_digits", with_(LAB, LINE_SQL, rf"""spaced AS (
  SELECT report_id, regexp_replace(line, '([^\p{{L}}\p{{N}}_.])', '\1\1', 'g') AS line FROM ls),
nums AS (
  SELECT report_id, regexp_extract_all(line, '(?:^|[^\p{{L}}\p{{N}}_.])(\d+\.\d+)(?:{NW}|$)', 1) AS ns FROM spaced),
places AS (
  SELECT report_id, list_sort(list_distinct(flatten(list(list_transform(ns, lambda n: length(split_part(n, '.', 2))))
           FILTER (len(ns) >= 2)))) AS p FROM nums GROUP BY report_id)""") + """
SELECT d.doc_id AS report_id, coalesce(array_to_string(p, ','), '') AS places FROM documents d
LEFT JOIN places ON places.report_id = d.doc_id""")
def k8(t):
    return t.lab_lines.select("report_id", F.array_join(C.decimal_places(_lines()).cast("array<string>"), ",").alias("places"))


@query("k9_check_units", with_(LAB, rf"""counts AS (
  SELECT doc_id AS report_id, len(regexp_extract_all(text, '{re2(K.UNIT_PATTERN)}')) AS n FROM lab)""") + """
SELECT report_id, CAST(CASE WHEN n >= 5 THEN 100 WHEN n >= 1 THEN 60 ELSE 20 END AS DOUBLE) AS score,
       CASE WHEN n >= 5 THEN '通过' ELSE '偏弱' END AS status FROM counts""")
def k9(t):
    return _lab_item(t, "单位与量纲", C.check_units(F.col("raw_text"))).drop("problem")


@query("k10_check_figures", with_(LAB, LINE_SQL, rf"""figs AS (
  SELECT report_id, len(regexp_extract_all(line, '{K.FIGURE_PATTERN}')) AS n,
         trim(regexp_replace(regexp_extract(line, '.*(?:图|表|截图|Fig(?:ure)?|Table)\s*\d+(.*)$', 1), '^[\s:：·、.、\-—]*', ''), {WS}) AS rest
  FROM ls)""") + """
SELECT report_id, CAST(sum(n) AS BIGINT) AS figures, count(*) FILTER (n > 0 AND length(rest) < 2) AS uncaptioned
FROM figs GROUP BY report_id""")
def k10(t):
    counts = C.figure_counts(_lines())
    return t.lab_lines.select("report_id", counts.alias("c")).select("report_id", "c.figures", "c.uncaptioned")


@query("k11_check_references", with_(LAB, rf"""counts AS (
  SELECT doc_id AS report_id, len(regexp_extract_all(text, '\[\d+\]')) AS r,
         len(regexp_extract_all(text, '{K.CITE_PATTERN}')) AS c FROM lab)""") + """
SELECT report_id, CAST(CASE WHEN r >= 3 OR (r >= 1 AND c > 0) THEN 100 WHEN r > 0 OR c > 0 THEN 60 ELSE 0 END AS DOUBLE) AS score,
       CASE WHEN r >= 3 OR (r >= 1 AND c > 0) THEN '' ELSE r || ' numbered references, ' || c || ' links or titles' END AS problem
FROM counts""")
def k11(t):
    return _lab_item(t, "引用与格式", C.check_references(F.col("raw_text"))).drop("status")


@query("k12_empty_text", f"""
SELECT doc_id AS report_id, item, '缺失' AS status, 'no text could be extracted' AS problem
FROM documents CROSS JOIN (SELECT unnest({C.RULE_ITEMS!r}) AS item) WHERE doc_id % 10 = 0""")
def k12(t):
    emptied = t.lab.withColumns({
        "raw_text": F.when(F.col("report_id") % 10 == 0, F.lit(" \n ")).otherwise(F.col("raw_text"))})
    out = C.rule_check(emptied).where(F.get("issues", F.lit(0))["problem"] == "no text could be extracted")
    return out.select("report_id", "item", "status", F.get("issues", F.lit(0))["problem"].alias("problem"))


RULE_COUNTS = rf"""per_line AS (
  SELECT report_id, count(*) FILTER (regexp_matches(line, '{STEP_RE}')) AS steps, sum(len(regexp_extract_all(line, '{K.FIGURE_PATTERN}'))) AS figures,
         count(*) FILTER (regexp_matches(line, '{K.FIGURE_PATTERN}') AND length(trim(regexp_replace(
           regexp_extract(line, '.*(?:图|表|截图|Fig(?:ure)?|Table)\s*\d+(.*)$', 1), '^[\s:：·、.、\-—]*', ''), {WS})) < 2) AS bare FROM ls GROUP BY 1),
spaced AS (SELECT report_id, regexp_replace(line, '([^\p{{L}}\p{{N}}_.])', '', 'g') AS line FROM ls),
nums AS (SELECT report_id, regexp_extract_all(line, '(?:^|[^\p{{L}}\p{{N}}_.])(\d+\.\d+)(?:{NW}|$)', 1) AS ns FROM spaced),
places AS (
  SELECT report_id, len(list_distinct(flatten(list(list_transform(ns, lambda n: length(split_part(n, '.', 2)))) FILTER (len(ns) >= 2)))) AS p
  FROM nums GROUP BY 1),
whole AS (
  SELECT doc_id AS report_id, len(regexp_extract_all(text, '{re2(K.UNIT_PATTERN)}')) AS units, len(regexp_extract_all(text, '{K.TABLE_HINT_PATTERN}')) AS marks,
         len(regexp_extract_all(text, '\d+[\s	,，]+\d+')) AS rows_, len(regexp_extract_all(text, '\[\d+\]')) AS refs,
         len(regexp_extract_all(text, '{K.CITE_PATTERN}')) AS cites FROM lab)"""
GRADED = "CASE WHEN score = 100 THEN '通过' WHEN score > 0 THEN '偏弱' ELSE '缺失' END"


@query("k13_rule_check", BY_LINE.rstrip() + ",\n" + LINE_SQL + rf""",
filled AS (
  SELECT d.doc_id AS report_id, count(s.slot) AS n, coalesce(max(length(trim(s.body, {WS}))) FILTER (s.slot = '实验目的'), 0) AS purpose
  FROM documents d LEFT JOIN every_slot s ON s.report_id = d.doc_id GROUP BY 1),
""" + RULE_COUNTS + rf""",
m AS (SELECT * FROM whole JOIN filled USING (report_id) JOIN per_line USING (report_id) LEFT JOIN places USING (report_id)),
scored AS (
  SELECT report_id, '结构与完整性' AS item, round_even(n / 8 * 100, 0) AS score FROM m
  UNION ALL SELECT report_id, '实验目的', CASE WHEN purpose >= 80 THEN 100 WHEN purpose >= 30 THEN 60 ELSE 0 END FROM m
  UNION ALL SELECT report_id, '步骤可复现性', CASE WHEN steps >= 3 AND units >= 3 THEN 100 WHEN steps >= 1 AND units >= 1 THEN 65
                                              WHEN steps > 0 OR units > 0 THEN 40 ELSE 0 END FROM m
  UNION ALL SELECT report_id, '原始数据表', CASE WHEN marks > 0 AND rows_ >= 3 THEN 100 WHEN rows_ >= 1 OR marks > 0 THEN 55 ELSE 0 END FROM m
  UNION ALL SELECT report_id, '有效数字', CASE WHEN coalesce(p, 0) > 2 THEN 55 ELSE 100 END FROM m
  UNION ALL SELECT report_id, '单位与量纲', CASE WHEN units >= 5 THEN 100 WHEN units >= 1 THEN 60 ELSE 20 END FROM m
  UNION ALL SELECT report_id, '图表规范', CASE WHEN figures > 0 AND bare = 0 THEN 100 WHEN figures > 0 THEN 50 ELSE 0 END FROM m
  UNION ALL SELECT report_id, '引用与格式', CASE WHEN refs >= 3 OR (refs >= 1 AND cites > 0) THEN 100 WHEN refs > 0 OR cites > 0 THEN 60 ELSE 0 END FROM m)
SELECT report_id, item, CAST(score AS DOUBLE) AS score,
       CASE item WHEN '结构与完整性' THEN CASE WHEN n >= 7 THEN '通过' WHEN n >= 4 THEN '偏弱' ELSE '缺失' END ELSE {GRADED} END AS status
FROM scored JOIN filled USING (report_id)""")
def k13(t):
    return C.rule_check(t.lab).select("report_id", "item", "score", "status")


@query("k14_sanitize_checks", f"""
WITH payload AS (
  SELECT user_id AS check_id, CASE event_type WHEN 'view' THEN '原理阐述' WHEN 'signup' THEN '数据处理与计算' WHEN 'error' THEN '误差分析'
           WHEN 'purchase' THEN '没有的项' ELSE '结论与讨论' END AS item, event_id AS seq, floor(value) AS score,
         CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE '通过' END AS status, event_id % 6 AS n_issues, event_id % 9 AS n_words,
         event_id % 2 AS odd
  FROM events),
last AS (SELECT * FROM payload QUALIFY row_number() OVER (PARTITION BY check_id, item ORDER BY seq DESC) = 1),
wanted AS (SELECT * FROM (SELECT DISTINCT check_id FROM payload) CROSS JOIN (SELECT unnest({C.AI_ITEMS!r}) AS item))
SELECT w.check_id, w.item, CASE WHEN seq IS NULL THEN 0.0::DOUBLE ELSE least(score, 100) END AS score,
       CASE WHEN seq IS NULL THEN '未检测' WHEN status = 'unknown' THEN '偏弱' ELSE status END AS status,
       CASE WHEN seq IS NULL THEN 1 ELSE least(n_issues, 3) END AS n_issues,
       CASE WHEN seq IS NULL OR n_issues = 0 THEN '' WHEN n_words * 8 - 1 <= 40 THEN trim(repeat('improve ', n_words))
            ELSE left(repeat('improve ', n_words), 39) || '…' END AS direction,
       CASE WHEN seq IS NULL THEN '较小' WHEN n_issues = 0 THEN '' WHEN odd = 0 THEN '较大' ELSE '中' END AS impact
FROM wanted w LEFT JOIN last USING (check_id, item)""")
def k14(t):
    first = F.get("issues", F.lit(0))
    return C.sanitize_checks(t.payload).select(
        "check_id", "item", "score", "status", F.size("issues").alias("n_issues"),
        F.coalesce(first["direction"], F.lit("")).alias("direction"), F.coalesce(first["impact"], F.lit("")).alias("impact"))


def _items(t):
    """All versions of all checks, each a check of its own."""
    return t.check_items.withColumn("check_id", F.concat_ws("/", "check_id", "version"))


NOW = with_(CHECKS, "now_ AS (SELECT * REPLACE (check_id || '/' || version AS check_id) FROM items)")


@query("k15_check_total", NOW + """
SELECT check_id, coalesce(sum(weight * score) FILTER (status <> '未检测') / sum(weight) FILTER (status <> '未检测'), 0) AS total
FROM now_ GROUP BY check_id""")
def k15(t):
    return C.check_total(_items(t))


@query("k16_check_summary", NOW + """
SELECT check_id, count(*) FILTER (status <> '未检测') AS tested, count(*) FILTER (status = '通过') AS passed,
       count(*) FILTER (status IN ('偏弱', '缺失')) AS weak,
       CAST(coalesce(sum(weight) FILTER (status <> '未检测'), 0) AS BIGINT) AS tested_weight,
       coalesce(string_agg(item, '|' ORDER BY item) FILTER (status = '未检测'), '') AS untested
FROM now_ GROUP BY check_id""")
def k16(t):
    return C.check_summary(_items(t)).withColumn("untested", F.array_join("untested", "|"))


@query("k17_rank_issues", NOW + """
SELECT check_id, row_number() OVER (PARTITION BY check_id ORDER BY status <> '缺失', weight DESC, item_ord) AS rank, item, status, weight
FROM now_ WHERE status IN ('偏弱', '缺失')""")
def k17(t):
    return C.rank_issues(_items(t))


@query("k18_checklist", NOW.rstrip() + f""",
catalog AS (SELECT unnest({list(K.CHECK_ITEMS)!r}) AS item, unnest({[w for w, _ in K.CHECK_ITEMS.values()]!r}) AS weight)
SELECT c.check_id, k.item, k.weight, coalesce(n.status, '未检测') AS status, coalesce(n.score, 0) AS score
FROM (SELECT DISTINCT check_id FROM now_) c CROSS JOIN catalog k LEFT JOIN now_ n ON n.check_id = c.check_id AND n.item = k.item""")
def k18(t):
    return C.checklist(_items(t)).select("check_id", "item", "weight", "status", "score")


@query("k19_diff_checks", with_(CHECKS) + """
SELECT n.check_id, n.item, coalesce(CAST(o.score AS DOUBLE), -1) AS old_score, CAST(n.score AS DOUBLE) AS score,
       CASE WHEN o.status <> '通过' AND n.status = '通过' THEN 'fixed'
            WHEN o.status = '未检测' AND n.status <> '未检测' THEN 'newly_tested'
            WHEN n.score > coalesce(o.score, 0) THEN 'better' WHEN n.score = coalesce(o.score, 0) THEN 'same' ELSE 'worse' END AS mark,
       n.score - coalesce(o.score, 0) AS gain
FROM items n LEFT JOIN (SELECT check_id, 1 + (item_ord - 1 + 11) % 12 AS item_ord, score, status FROM items WHERE version = 0) o
  ON o.check_id = n.check_id AND o.item_ord = n.item_ord AND o.check_id % 4 <> 0
WHERE n.version = 1""".replace("1 + (item_ord - 1 + 11) % 12 AS item_ord", "item_ord + 1 AS item_ord"))
def k19(t):
    # items alternate between versions by parity, so the old version is shifted by one item to meet the new one
    names = X.words(list(K.CHECK_ITEMS))
    old = t.check_items.where("version = 0 and check_id % 4 <> 0").withColumn(
        "item", F.get(names, F.array_position(names, F.col("item")).cast("int")))
    return _doubles(C.diff_checks(old, t.check_items.where("version = 1")), "score").select(
        "check_id", "item", F.coalesce(F.col("old_score").cast("double"), F.lit(-1.0)).alias("old_score"), "score", "mark", "gain")


def _of_profile(profile: str, tag: str) -> str:
    """The slot statements again with the words of another profile, every name ending in ``tag``."""
    words = K.PROFILE_KEYWORDS.get(profile, K.PROFILE_KEYWORDS[K.GENERAL])
    vocab = "vocab(slot_ord, slot, ws) AS (VALUES " + ", ".join(
        f"({i}, '{slot}', {list(w)!r})" for i, (slot, w) in enumerate(zip(K.SECTION_SLOTS, words))) + ")"
    below = BY_LINE[BY_LINE.index("cand AS ("):].replace(repr(ALL_WORDS), repr([w for ws in words for w in ws]))
    text = ",\n".join((vocab, SLOTS, below.rstrip()))
    for name in ("vocab", "hits", "slots", "cand", "below", "above_end", "slot_bodies", "every_slot"):
        text = re.sub(rf"(?<![A-Za-z_.'$]){name}(?![A-Za-z_'.])", name + tag, text)
        text = re.sub(rf"(?<![A-Za-z_'$]){name}(?=\.)", name + tag, text)
    return text


WEIGHT = {name: weight for name, (weight, _) in K.CHECK_ITEMS.items()}
PER_PROFILE = "\nUNION ALL ".join(f"""SELECT {i} AS no, d.doc_id AS report_id, count(s.slot) AS n,
  coalesce(max(length(trim(s.body, {WS}))) FILTER (s.slot = '实验目的'), 0) AS purpose,
  coalesce(max(trim(s.body, {WS})) FILTER (s.slot = '原始数据表'), '') AS output
FROM documents d LEFT JOIN every_slot_p{i} s ON s.report_id = d.doc_id GROUP BY d.doc_id""" for i in range(1, len(K.PROFILES) + 1))


@query("k20_profile_matrix", BY_LINE[:BY_LINE.index("cand AS (")].rstrip() + "\n" + ",\n".join(
    _of_profile(profile, f"_p{i}") for i, profile in enumerate(K.PROFILES, 1)) + ",\n" + LINE_SQL + f""",
per_profile AS ({PER_PROFILE}),
""" + RULE_COUNTS + rf""",
computing AS (
  SELECT doc_id AS report_id, len(regexp_extract_all(text, '{re2(K.COMPUTING_PARAM_PATTERN)}')) AS params,
         len(regexp_extract_all(text, '{re2(K.COMPUTING_QUANT_PATTERN)}')) AS quants FROM lab),
mm AS (
  SELECT *, CASE WHEN no = {K.PROFILES.index(K.COMPUTING) + 1} THEN params ELSE units END AS p_, CASE WHEN no = {K.PROFILES.index(K.COMPUTING) + 1} THEN quants ELSE units END AS u_,
         length(output) AS o_n, len(regexp_extract_all(output, '\d')) AS o_digits,
         CASE WHEN output = '' THEN 0 ELSE len(list_filter(string_split(output, chr(10)), lambda l: trim(l, {WS}) <> '')) END AS o_rows
  FROM whole JOIN per_profile USING (report_id) JOIN per_line USING (report_id) JOIN computing USING (report_id) LEFT JOIN places USING (report_id)),
totals AS (
  SELECT report_id, no, round((
    {WEIGHT['结构与完整性']} * round_even(n / 8 * 100, 0) + {WEIGHT['实验目的']} * CASE WHEN purpose >= 80 THEN 100 WHEN purpose >= 30 THEN 60 ELSE 0 END
    + {WEIGHT['步骤可复现性']} * CASE WHEN steps >= 3 AND p_ >= 3 THEN 100 WHEN steps >= 1 AND p_ >= 1 THEN 65 WHEN steps > 0 OR p_ > 0 THEN 40 ELSE 0 END
    + {WEIGHT['原始数据表']} * CASE WHEN no = {K.PROFILES.index(K.COMPUTING) + 1}
        THEN CASE WHEN o_n >= 80 OR o_digits >= 20 OR o_rows >= 6 THEN 100 WHEN o_n >= 30 OR o_digits >= 5 OR o_rows >= 2 THEN 70 WHEN o_n > 0 THEN 25 ELSE 0 END
        ELSE CASE WHEN marks > 0 AND rows_ >= 3 THEN 100 WHEN rows_ >= 1 OR marks > 0 THEN 55 ELSE 0 END END
    + {WEIGHT['有效数字']} * CASE WHEN coalesce(p, 0) > 2 THEN 55 ELSE 100 END
    + {WEIGHT['单位与量纲']} * CASE WHEN u_ >= 5 THEN 100 WHEN u_ >= 1 THEN 60 ELSE 20 END
    + {WEIGHT['图表规范']} * CASE WHEN figures > 0 AND bare = 0 THEN 100 WHEN figures > 0 THEN 50 ELSE 0 END
    + {WEIGHT['引用与格式']} * CASE WHEN refs >= 3 OR (refs >= 1 AND cites > 0) THEN 100 WHEN refs > 0 OR cites > 0 THEN 60 ELSE 0 END
  ) / {sum(WEIGHT[i] for i in C.RULE_ITEMS)}::DOUBLE, 1) AS total FROM mm),
ties AS (
  SELECT report_id, string_agg({list(K.PROFILES)!r}[no], '=' ORDER BY no) AS g, min(no) AS m FROM totals GROUP BY report_id, total HAVING count(*) > 1),
tied_names AS (SELECT report_id, string_agg(g, '|' ORDER BY m) AS tied FROM ties GROUP BY report_id)
SELECT report_id, coalesce(any_value(tied), '') AS tied, """ + ", ".join(f"max(total) FILTER (no = {i}) AS p{i}" for i in range(1, len(K.PROFILES) + 1)) + """,
       count(DISTINCT total) AS distinct_totals FROM totals LEFT JOIN tied_names USING (report_id) GROUP BY report_id""")
def k20(t):
    out = C.profile_matrix(t.lab.select("report_id", "raw_text", "sections"))
    return out.withColumn("tied", F.array_join(F.transform("tied", lambda g: F.array_join(g, "=")), "|"))


# ---- history -----------------------------------------------------------------------
HIST = with_(HISTORY)
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamped(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query("h1_append_history", HIST + f"""
SELECT sid, archive_key, {STAMP.format('saved_at')} AS saved_at, seq, entry_id FROM history""")
def h1(t):
    return _stamped(H.append_history(t.entries), "saved_at").select("sid", "archive_key", "saved_at", "seq", "entry_id")


@query("h2_load_history", HIST + f"""
SELECT archive_key, {STAMP.format('saved_at')} AS saved_at, seq, total FROM history WHERE sid = '00000003'""")
def h2(t):
    return _stamped(H.load_history(t.history, "00000003"), "saved_at").select("archive_key", "saved_at", "seq", "total")


@query("h3_history_index", HIST + f"""
SELECT sid, archive_key, arg_max(name, (saved_at, seq)) AS name, {STAMP.format('max(saved_at)')} AS saved_at, count(*) AS entries
FROM history GROUP BY 1, 2""")
def h3(t):
    return _stamped(H.history_index(t.history), "saved_at")


@query("h4_trend", HIST + f"""
SELECT sid, archive_key, {STAMP.format('saved_at')} AS saved_at, seq, total,
       coalesce(total - lag(total) OVER (PARTITION BY sid, archive_key ORDER BY saved_at, seq), -999) AS step FROM history""")
def h4(t):
    return _stamped(H.trend(t.history), "saved_at").withColumn("step", F.coalesce("step", F.lit(-999)))


@query("h4_trend_change", HIST + """
SELECT sid, archive_key, count(*) AS entries, arg_min(total, (saved_at, seq)) AS first_total,
       arg_max(total, (saved_at, seq)) AS last_total,
       arg_max(total, (saved_at, seq)) - arg_min(total, (saved_at, seq)) AS change FROM history GROUP BY 1, 2""")
def h4b(t):
    return H.trend_change(t.history)


@query("h5_latest_two", HIST + """
SELECT sid, archive_key, max(entry_id) FILTER (age = 1) AS entry_id, max(entry_id) FILTER (age = 2) AS previous_id,
       max(total) FILTER (age = 1) AS total, max(total) FILTER (age = 2) AS previous_total
FROM (SELECT *, row_number() OVER (PARTITION BY sid, archive_key ORDER BY saved_at DESC, seq DESC) AS age FROM history)
WHERE age <= 2 GROUP BY 1, 2 HAVING count(*) = 2""")
def h5(t):
    return H.latest_two(t.history)


@query("h6_delete_entries", HIST + """
SELECT sid, archive_key, count(*) AS entries FROM history
WHERE entry_id % 9 <> 0 AND archive_key NOT LIKE '%5' GROUP BY 1, 2""")
def h6(t):
    one = H.delete_entries(t.history, t.history.where("entry_id % 9 = 0").select("entry_id"))
    left = H.delete_entries(one, t.history.where("archive_key like '%5'").select("sid", "archive_key"))
    return left.groupBy("sid", "archive_key").agg(F.count("*").alias("entries"))


@query("h7_valid_spaces", HIST + """
SELECT sid, count(*) AS entries FROM history WHERE regexp_matches(sid, '^[0-9a-f]{8,64}$') GROUP BY sid""")
def h7(t):
    return H.valid_spaces(t.history).groupBy("sid").agg(F.count("*").alias("entries"))


# every user of the fixture stays active until its last day: the saves of each archive are moved back by some days of its own
MOVED = """moved AS (SELECT * REPLACE (saved_at - to_days(CAST(right(archive_key, 1) AS INTEGER) % 3 + CAST(substr(archive_key, 7, 1) AS INTEGER)) AS saved_at) FROM history)"""
NOW_TS = "2024-01-31 00:00:00"


def _moved(t):
    days = F.right("archive_key", F.lit(1)).cast("int") % 3 + F.substring("archive_key", 7, 1).cast("int")
    return t.history.withColumn("saved_at", F.col("saved_at") - F.make_dt_interval(days))


@query("h8_stale_spaces", with_(HISTORY, MOVED) + f"""
SELECT sid, {STAMP.format('max(saved_at)')} AS newest FROM moved GROUP BY sid
HAVING max(saved_at) < TIMESTAMP '{NOW_TS}' - INTERVAL 4 DAY""")
def h8(t):
    return _stamped(H.stale_spaces(_moved(t), F.to_timestamp(F.lit(NOW_TS)), 4), "newest")


@query("h8_sweep_stale", with_(HISTORY, MOVED) + f"""
SELECT sid, count(*) AS entries FROM moved GROUP BY sid HAVING max(saved_at) >= TIMESTAMP '{NOW_TS}' - INTERVAL 4 DAY""")
def h8b(t):
    kept = H.sweep_stale(_moved(t), F.to_timestamp(F.lit(NOW_TS)), 4)
    return kept.groupBy("sid").agg(F.count("*").alias("entries"))


@query("h9_space_quota", HIST + "SELECT count(DISTINCT sid) AS spaces, count(DISTINCT sid) < 200 AS can_open FROM history")
def h9(t):
    return H.space_quota(t.history)


@query("h9_known_spaces", HIST + """
SELECT c_custkey FROM customer WHERE lower(lpad(to_hex(c_custkey), 8, '0')) IN (SELECT sid FROM history)""")
def h9b(t):
    candidates = t.raw("customer").select("c_custkey", F.lower(F.lpad(F.hex("c_custkey"), 8, "0")).alias("sid"))
    return H.known_spaces(candidates, t.history).select("c_custkey")


# ---- page transcripts --------------------------------------------------------------
PAGES = """pages_ AS (
  SELECT conv_id AS report_id, CAST(turn + 1 AS INTEGER) AS page_no, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text,
         (turn + conv_id) % 3 = 0 AS pictured, CASE WHEN conv_id % 2 = 0 THEN '表格' ELSE '图片' END AS kind_cn,
         left(text, 12) AS cap, CASE WHEN conv_id % 3 = 0 THEN 'x = 1' ELSE '' END AS content,
         CASE WHEN role = 'system' THEN 'blurred' ELSE '' END AS notes, CASE WHEN turn % 5 = 4 THEN 'timeout' ELSE '' END AS error,
         role = 'user' AS cached FROM conversations),
blocks AS (
  SELECT report_id, page_no, concat_ws(chr(10), '第 ' || page_no || ' 页 OCR 转录', '',
           CASE WHEN trim(text, {ws}) <> '' THEN trim(text, {ws}) WHEN NOT pictured THEN '（本页无可转录文字）' END,
           CASE WHEN pictured THEN rtrim('[' || kind_cn || '] ' || trim(cap, {ws})) || CASE WHEN content <> '' THEN '：' || content ELSE '' END END,
           CASE WHEN notes <> '' THEN '（转录说明：' || notes || '）' END) AS block FROM pages_),
transcripts AS (
  SELECT report_id, '{head}' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY page_no) || chr(10) AS transcript
  FROM blocks GROUP BY report_id)""".replace("{ws}", WS).replace("{head}", K.TRANSCRIPT_HEAD)


@query("o1_vision_triage", rf"""
WITH src AS (
  SELECT doc_id, trim(text, {WS}) AS t, text, doc_id % 5 = 0 AS shot, doc_id % 4 = 0 AS code, doc_id % 3 AS images, doc_id % 7 = 0 AS scan
  FROM documents)
SELECT doc_id AS report_id, length(trim(text || CASE WHEN shot THEN ' 运行结果' ELSE '' END || CASE WHEN code THEN ' import os' ELSE '' END, {WS})) AS text_chars,
       concat_ws('|', CASE WHEN scan THEN 'parser_warning' END, CASE WHEN shot AND NOT code THEN 'screenshots_without_code' END,
         CASE WHEN images > 0 AND code THEN 'images_beside_code' END, CASE WHEN images > 0 AND NOT code THEN 'images' END,
         CASE WHEN length(trim(text || CASE WHEN shot THEN ' 运行结果' ELSE '' END, {WS})) < 300 AND NOT code THEN 'thin_text' END) AS reasons,
       CASE WHEN NOT (scan OR (shot AND NOT code) OR images > 0
                      OR (length(trim(text || CASE WHEN shot THEN ' 运行结果' ELSE '' END, {WS})) < 300 AND NOT code)) THEN ''
            WHEN code AND NOT scan THEN 'caption' ELSE 'transcribe' END AS mode
FROM src""")
def o1(t):
    r = F.col("report_id")
    spiked = F.concat("raw_text", F.when(r % 5 == 0, " 运行结果").otherwise(""), F.when(r % 4 == 0, " import os").otherwise(""))
    reports = t.reports.select("report_id", spiked.alias("full_text"), (r % 3).alias("embedded_images"),
                               F.when(r % 7 == 0, F.array(F.lit("疑似扫描件"))).otherwise(F.array(F.lit("ok"))).alias("warnings"))
    return O.vision_triage(reports).select("report_id", "text_chars", F.array_join("reasons", "|").alias("reasons"), "mode")


@query("o2_normalize_pages", with_(PAGES) + f"""
SELECT report_id, page_no, trim(text, {WS}) AS text, CASE WHEN NOT pictured THEN '' WHEN kind_cn = '表格' THEN 'table' ELSE 'other' END AS kind,
       CASE WHEN pictured THEN trim(cap, {WS}) ELSE '' END AS caption, notes FROM pages_""")
def o2(t):
    image = F.get("images", F.lit(0))
    return O.normalize_pages(t.pages).select(
        "report_id", "page_no", "text", F.coalesce(image["kind"], F.lit("")).alias("kind"),
        F.coalesce(image["caption"], F.lit("")).alias("caption"), "notes")


@query("o3_page_text", with_(PAGES) + "SELECT report_id, transcript FROM transcripts")
def o3(t):
    return O.page_text(O.normalize_pages(t.pages))


@query("o4_enrich_reports", with_(PAGES) + f"""
SELECT doc_id AS report_id, CASE WHEN transcript IS NULL THEN d.text ELSE rtrim(d.text, {WS}) || chr(10) || chr(10) || transcript END AS raw_text,
       CASE WHEN transcript IS NULL THEN 0 ELSE length(rtrim(d.text, {WS})) + 2 + length(transcript) - length(d.text) END AS added_chars
FROM documents d LEFT JOIN transcripts t ON t.report_id = d.doc_id""")
def o4(t):
    return O.enrich_reports(t.reports, O.normalize_pages(t.pages)).select("report_id", "raw_text", "added_chars")


ENRICHED = f"""enriched AS (
  SELECT doc_id, CASE WHEN transcript IS NULL THEN d.text ELSE rtrim(d.text, {WS}) || chr(10) || chr(10) || transcript END AS text
  FROM documents d LEFT JOIN transcripts t ON t.report_id = d.doc_id)"""
WHOLE = "enriched_raw AS (SELECT doc_id AS report_id, text AS raw FROM enriched)"


@query("o4_enriched_sections", with_(PAGES, ENRICHED, LINES.replace("FROM documents)", "FROM enriched)"), SECTIONS, WHOLE, located("sections", "enriched_raw", "raw")).replace(
    "WITH ", "WITH RECURSIVE ", 1) + """
SELECT s.report_id, s.section_ord, section_id, title, level, a AS char_start, a + n AS char_end FROM sections s JOIN loc USING (report_id, section_ord)""")
def o4b(t):
    return S.split_sections(O.enrich_reports(t.reports, O.normalize_pages(t.pages))).drop("text")


@query("o5_page_stats", with_(PAGES) + """
SELECT report_id, count(*) AS pages_read, count(*) FILTER (cached) AS cached_hits, CAST(sum(length(text)) AS BIGINT) AS chars,
       count(*) FILTER (pictured) AS images, count(*) FILTER (error <> '') AS failed FROM pages_ GROUP BY report_id""")
def o5(t):
    return O.page_stats(t.pages)


@query("o6_pending_pages", """
WITH wanted AS (
  SELECT conv_id AS report_id, CAST(turn + 1 AS INTEGER) AS page_no, role,
         left(sha256(concat_ws('_', sha256(CAST(conv_id AS VARCHAR)), CAST(turn + 1 AS VARCHAR), '150', 'm', 'v1', 'tr')), 32) AS page_key
  FROM conversations)
SELECT report_id, page_no, page_key FROM wanted
WHERE page_key NOT IN (SELECT page_key FROM wanted WHERE role = 'user')""")
def o6(t):
    wanted = t.raw("conversations").select(
        F.col("conv_id").alias("report_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role",
        F.sha2(F.col("conv_id").cast("string"), 256).alias("digest"), F.lit(150).alias("dpi"), F.lit("m").alias("model"),
        F.lit("v1").alias("prompt_version"), F.lit("tr").alias("mode"))
    stored = wanted.where("role = 'user'").select(O.page_key(*[F.col(c) for c in (
        "digest", "page_no", "dpi", "model", "prompt_version", "mode")]).alias("page_key"))
    return O.pending_pages(wanted, stored).select("report_id", "page_no", "page_key")


@query("o7_compare_runs", with_(DETAILS, FIRST) + """
SELECT coalesce(a.report_id, b.report_id) AS report_id, coalesce(a.item_id, b.item_id) AS item_id,
       coalesce(a.score_c / 100.0, -1) AS score_before, coalesce(b.score_c / 100.0, -1) AS score_after,
       CASE WHEN a.report_id IS NULL THEN 0 ELSE 1 END AS quotes_before, CASE WHEN b.report_id IS NULL THEN 0 ELSE 2 END AS quotes_after,
       CASE WHEN b.verdict = 'hit' THEN 'hit' ELSE '' END AS found
FROM (SELECT * FROM firsts WHERE pos % 5 <> 0) a FULL JOIN (SELECT * FROM firsts WHERE pos % 7 <> 0) b USING (report_id, item_id)""")
def o7(t):
    judged = CV.first_judgement(t.details)
    before = judged.where("pos % 5 <> 0").withColumn("evidence", F.array("verdict"))
    after = judged.where("pos % 7 <> 0").withColumn("evidence", F.array("verdict", F.lit("-")))
    out = O.compare_runs(before, after, ["hit"])
    return out.withColumns({"score_before": F.coalesce(F.col("score_before").cast("double"), F.lit(-1.0)),
                            "score_after": F.coalesce(F.col("score_after").cast("double"), F.lit(-1.0)),
                            "found": F.array_join("found", "|")})
