"""Text preparation, rubric, redaction and clipping queries on documents, pages and part."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators import judge as J
from ..operators import redact as R
from ..operators import rubric as B
from ..operators import sections as S
from .catalog import query
from .fixtures import ATTEMPTS, COURSES, TEXTS, canonical_cte, with_
from .q_judge import RUBRIC_SQL, SPIKED, _spiked

WS = "chr(32) || chr(9) || chr(10) || chr(13)"
HEAD_RE = "|".join(f"(?:{p})" for p in K.HEADING_PATTERNS)
LINES = f"""parts AS (
  SELECT doc_id AS report_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (
  SELECT *, trim(line, {WS}) AS s,
         trim(coalesce(lead(line) OVER (PARTITION BY report_id ORDER BY line_no), ''), {WS}) AS nxt FROM parts),
marked AS (
  SELECT *, length(s) BETWEEN 2 AND 30 AND strpos('。；，,;、？?！!', right(s, 1)) = 0
            AND (right(s, 1) = '：' OR nxt = '' OR length(nxt) > length(s) * 1.6 OR regexp_matches(line, '{HEAD_RE}')) AS head
  FROM lines)"""
LEVEL = r"CASE WHEN regexp_matches(title, '^\s*\(?\d+(\.\d+){2}') THEN 3 WHEN regexp_matches(title, '^\s*\(?\d+(\.\d+)') THEN 2 ELSE 1 END"
SECTIONS = f"""numbered AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY report_id ORDER BY line_no) AS sec,
         sum(head::INT) OVER (PARTITION BY report_id) AS n_heads FROM marked),
bodies AS (
  SELECT report_id, sec, trim(string_agg(line, chr(10) ORDER BY line_no), {WS}) AS body,
         CASE WHEN sec = 0 THEN '报告头部' ELSE left(arg_min(s, line_no), 40) END AS title
  FROM numbered WHERE n_heads >= 2 GROUP BY report_id, sec),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY sec) - 1 AS idx FROM bodies
  WHERE sec > 0 OR length(body) >= 40),
islands AS (
  SELECT *, sum((idx = 0 OR length(body) >= 40)::INT) OVER (PARTITION BY report_id ORDER BY idx) - 1 AS ord FROM kept),
sections AS (
  SELECT report_id, CAST(ord AS INTEGER) AS section_ord, 's' || (min(idx) + 1) AS section_id,
         arg_min(title, idx) AS title, string_agg(body, chr(10) ORDER BY idx) AS text,
         CASE WHEN min(sec) = 0 THEN 1 ELSE arg_min({LEVEL}, idx) END AS level
  FROM islands GROUP BY report_id, ord
  UNION ALL
  SELECT report_id, CAST(i - 1 AS INTEGER), 's' || i, '第' || i || '段', substr(text, (i - 1) * 800 + 1, 800), 1
  FROM (SELECT DISTINCT report_id, text FROM numbered WHERE n_heads < 2) t,
       LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 800.0) AS BIGINT) + 1)) AS i))"""


def located(sections: str, texts: str, column: str) -> str:
    """Recursive search of each section text from the end of the one before it."""
    return f"""loc AS (
  SELECT s.report_id, s.section_ord, greatest(strpos(t.{column}, s.text) - 1, 0) AS a, length(s.text) AS n
  FROM {sections} s JOIN {texts} t USING (report_id) WHERE section_ord = 0
  UNION ALL
  SELECT s.report_id, s.section_ord,
         l.a + l.n + greatest(strpos(substr(t.{column}, l.a + l.n + 1), s.text) - 1, 0), length(s.text)
  FROM loc l JOIN {sections} s ON s.report_id = l.report_id AND s.section_ord = l.section_ord + 1
  JOIN {texts} t ON t.report_id = s.report_id)"""


RAW = "raws AS (SELECT doc_id AS report_id, text AS raw FROM documents)"
CANON = canonical_cte("ptexts", "(SELECT * RENAME (text AS raw_text) FROM sections)",
                      "report_id, section_ord, section_id, title, level") + """,
psections AS (SELECT * RENAME (full_text AS text) FROM ptexts)"""
SECT = with_(LINES, SECTIONS)
PARSED = with_(TEXTS, LINES, SECTIONS, CANON)


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _parsed(t):
    return S.parse_reports(t.reports)


@query("t1_canonical_ws", r"""
SELECT doc_id AS report_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""")
def t1(t):
    return t.reports.select("report_id", X.canonical_ws(F.col("raw_text")).alias("text"))


@query("t2_collapse_char_spacing", with_(TEXTS) + "SELECT report_id, full_text FROM texts")
def t2(t):
    return t.texts.select("report_id", "full_text")


@query("t3_is_heading", with_(LINES) + "SELECT report_id, line_no, s AS line, head FROM marked")
def t3(t):
    lines = X.bind(F.split("raw_text", "\n", -1), lambda ls: F.transform(ls, lambda line, i: F.struct(
        i.alias("line_no"), X.strip(line).alias("line"), S.is_heading(line, F.get(ls, i + 1)).alias("head"))))
    return t.reports.select("report_id", F.inline_outer(lines))


@query("t4_heading_level", with_(LINES).replace("marked AS", "marked AS") + f"""
SELECT report_id, line_no, {LEVEL} AS level FROM (SELECT *, s AS title FROM lines) WHERE s <> ''""")
def t4(t):
    rows = t.reports.select("report_id", F.posexplode_outer(F.split("raw_text", "\n", -1)).alias("line_no", "line"))
    title = X.strip(F.col("line"))
    return rows.where(title != "").select("report_id", "line_no", S.heading_level(title).alias("level"))


@query("t5_split_sections", SECT + """
SELECT report_id, section_ord, section_id, title, level, text FROM sections""")
def t5(t):
    return S.split_sections(t.reports).drop("char_start", "char_end")


@query("t7_section_offsets", SECT.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + RAW + ",\n"
       + located("sections", "raws", "raw") + """
SELECT report_id, section_ord, a AS char_start, a + n AS char_end FROM loc""")
def t7(t):
    return S.section_offsets(t.reports).drop("section_id")


@query("t8_chunk_text", """
SELECT doc_id AS report_id, CAST(i - 1 AS INTEGER) AS section_ord, substr(text, (i - 1) * 800 + 1, 800) AS text,
       (i - 1) * 800 AS char_start
FROM documents, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 800.0) AS BIGINT) + 1)) AS i)""")
def t8(t):
    return S.chunk_text(t.reports).select("report_id", "section_ord", "text", "char_start")


@query("t9_parse_reports", PARSED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n"
       + located("psections", "texts", "full_text") + """
SELECT t.report_id, md5(t.full_text) AS text_md5, count(*) AS n_sections, CAST(max(a + l.n) AS BIGINT) AS last_end
FROM texts t JOIN loc l USING (report_id) GROUP BY 1, 2""")
def t9(t):
    return _parsed(t).select("report_id", F.md5("full_text").alias("text_md5"), F.size("sections").alias("n_sections"),
                             F.array_max(F.transform("sections", lambda s: s["char_end"])).alias("last_end"))


@query("t10_inspect_reports", PARSED + """
SELECT report_id, length(full_text) AS chars, n AS n_sections,
       CASE WHEN length(full_text) = 0 THEN 'empty' WHEN length(full_text) <= 3000 THEN 'full' ELSE 'retrieved' END AS coverage,
       concat_ws('|', CASE WHEN length(full_text) = 0 THEN 'no_text' END,
         CASE WHEN length(full_text) BETWEEN 1 AND 199 THEN 'short_text' END,
         CASE WHEN length(full_text) > 3000 THEN 'over_limit' END) AS warnings
FROM texts JOIN (SELECT report_id, count(*) AS n FROM psections GROUP BY 1) USING (report_id)""")
def t10(t):
    return S.inspect_reports(_parsed(t), limit=3000).withColumn("warnings", F.array_join("warnings", "|"))


RECALLED = """scored AS (
  SELECT s.report_id, r.item_id, s.section_ord, s.section_id, s.title, s.text,
         len(list_filter(signals, lambda w: contains(s.text, w))) AS hits FROM psections s CROSS JOIN rub r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY report_id, item_id ORDER BY hits DESC, length(text), section_ord) AS rn,
         max(hits) OVER (PARTITION BY report_id, item_id) AS best FROM scored),
recalled AS (
  SELECT *, CASE WHEN best > 0 THEN rn ELSE section_ord + 1 END AS rank FROM ranked
  WHERE CASE WHEN best > 0 THEN rn <= 4 AND hits > 0 ELSE section_ord < 4 END)"""


@query("t11_recall_sections", with_(TEXTS, LINES, SECTIONS, CANON, RUBRIC_SQL, RECALLED) + """
SELECT report_id, item_id, rank, section_ord, section_id FROM recalled""")
def t11(t):
    return S.recall_sections(_parsed(t), t.rubric, 4)


@query("t12_build_context", with_(TEXTS, LINES, SECTIONS, CANON, RUBRIC_SQL, RECALLED) + """
SELECT report_id, item_id, length(full_text) <= 3000 AS is_full,
       md5(CASE WHEN length(full_text) <= 3000 THEN full_text ELSE ctx END) AS context_md5
FROM texts JOIN (
  SELECT report_id, item_id, string_agg('[' || section_id || '] ' || title || chr(10) || left(text, 3500), chr(10) || chr(10)
         ORDER BY rank) AS ctx FROM recalled GROUP BY 1, 2) USING (report_id)""")
def t12(t):
    out = S.build_context(_parsed(t), t.rubric, k=4, limit=3000)
    return out.select("report_id", "item_id", "is_full", F.md5("context").alias("context_md5"))


@query("t13_locate_quotes", with_(TEXTS, ATTEMPTS, LINES, SECTIONS, CANON).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
       + ",\n" + located("psections", "texts", "full_text") + """,
quotes AS (
  SELECT report_id, item_id, attempt_no, full_text, trim(unnest(evidence)) AS quote FROM attempts),
placed AS (SELECT *, strpos(full_text, quote) - 1 AS pos FROM quotes)
SELECT p.report_id, p.item_id, p.attempt_no, p.quote, p.pos AS char_start, coalesce((
         SELECT arg_min(s.section_id, l.section_ord) FROM loc l JOIN psections s USING (report_id, section_ord)
         WHERE l.report_id = p.report_id AND l.a <= p.pos AND p.pos < l.a + l.n), '') AS section_id
FROM placed p""")
def t13(t):
    parsed = _parsed(t)
    quotes = t.attempts.select("report_id", "item_id", "attempt_no", F.explode("evidence").alias("quote"))
    return S.locate_quotes(quotes.withColumn("quote", X.strip(F.col("quote"))), _parsed(t))


INJECTION_SQL = " ,".join(
    f"CASE WHEN regexp_matches(spiked_text, '(?i){p}') THEN '{label}' END" for p, label in K.INJECTION_PATTERNS)


@query("t14_detect_injection", with_(TEXTS, SPIKED) + f"""
SELECT s.report_id, concat_ws('|', {INJECTION_SQL}) AS labels,
       substr(s.spiked_text, greatest(strpos(s.spiked_text, 'ignore all') - 20, 1),
              least(20, strpos(s.spiked_text, 'ignore all') - 1) + length('ignore all previous instructions') + 20) AS snippet
FROM spiked s WHERE report_id % 3 = 0""")
def t14(t):
    return S.detect_injection(_spiked(t)).withColumn("labels", F.array_join("labels", "|"))


# ---- rubrics -----------------------------------------------------------------------
def _part_rubric(t):
    return t.raw("part").select(
        F.col("p_brand").alias("rubric_id"), F.col("p_partkey").cast("int").alias("ord"),
        F.when(F.col("p_partkey") % 101 == 0, " ").otherwise(F.col("p_type")).alias("item_id"),
        F.col("p_name").alias("name"), F.lit("").alias("criteria"),
        F.when(F.col("p_partkey") % 37 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 41 == 0, -1.0)
        .otherwise(F.col("p_size").cast("double")).alias("max_score"),
        F.array("p_name").alias("positive_signals"))


@query("b1_validate_rubrics", """
WITH items AS (
  SELECT p_brand AS rubric_id, CASE WHEN p_partkey % 101 = 0 THEN '' ELSE p_type END AS item_id,
         CASE WHEN p_partkey % 37 = 0 OR p_partkey % 41 = 0 OR p_size <= 0 THEN 1 ELSE 0 END AS bad FROM part),
g AS (SELECT rubric_id, item_id, count(*) AS n, sum(bad) AS bad FROM items GROUP BY 1, 2)
SELECT rubric_id, item_id, 'blank_id' AS problem FROM g WHERE item_id = ''
UNION ALL SELECT rubric_id, item_id, 'duplicate_id' FROM g WHERE n > 1 AND item_id <> ''
UNION ALL SELECT rubric_id, item_id, 'bad_max_score' FROM g WHERE bad > 0
UNION ALL SELECT 'Brand#none' || n_nationkey, '', 'empty' FROM nation""")
def b1(t):
    items = _part_rubric(t)
    listed = items.select("rubric_id").distinct().unionByName(
        t.raw("nation").select(F.concat(F.lit("Brand#none"), F.col("n_nationkey").cast("string")).alias("rubric_id")))
    return B.validate_rubrics(items, listed)


@query("b2_normalize_rubrics", """
WITH kept AS (
  SELECT p_brand AS rubric_id, p_partkey AS ord, p_size + 1 AS m FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 12),
summed AS (SELECT *, sum(m) OVER (PARTITION BY rubric_id) AS total, min(ord) OVER (PARTITION BY rubric_id) AS first FROM kept),
scaled AS (
  SELECT *, CASE WHEN total = 100 THEN m * 100 WHEN 2 * (m * 10000 % total) > total THEN m * 10000 // total + 1
            WHEN 2 * (m * 10000 % total) < total THEN m * 10000 // total
            ELSE m * 10000 // total + (m * 10000 // total) % 2 END AS c FROM summed)
SELECT rubric_id, ord, CAST(c + CASE WHEN ord = first THEN 10000 - sum(c) OVER (PARTITION BY rubric_id) ELSE 0 END AS DOUBLE) / 100
         AS max_score
FROM scaled""")
def b2(t):
    items = _part_rubric(t).join(t.raw("part").select(F.col("p_partkey").cast("int").alias("ord"), "p_size"), "ord")
    items = items.withColumn("max_score", (F.col("p_size") + 1).cast("double")).drop("p_size")
    return _doubles(B.normalize_rubrics(items), "max_score").select("rubric_id", "ord", "max_score")


@query("b3_rubric_hash", """
SELECT doc_id AS report_id, left(sha256(lang || '||' || text), 16) AS source_hash FROM documents""")
def b3(t):
    return t.reports.select("report_id", B.rubric_hash(F.col("course"), F.col("raw_text")).alias("source_hash"))


@query("b4_default_rubric", """
WITH r(item_id, top) AS (VALUES ('r1', 15), ('r2', 20), ('r3', 25), ('r4', 20), ('r5', 20))
SELECT source AS class_id, item_id, CAST(top AS DOUBLE) AS max_score, count(*) AS misses FROM documents CROSS JOIN r GROUP BY ALL""")
def b4(t):
    rubric = reduce(DataFrame.unionByName, [B.default_rubric(t.spark, course) for course in COURSES])
    judged = J.rule_judge(t.texts, rubric)
    return _doubles(judged.where("verdict = 'miss'").groupBy("class_id", "item_id", "max_score").agg(
        F.count("*").alias("misses")), "max_score")


@query("b5_rubric_diff", """
SELECT p_brand AS rubric_id, p_partkey AS ord, 'left' AS side FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT p_brand, p_partkey, 'right' FROM part WHERE p_partkey % 10 = 0""")
def b5(t):
    # names carry the key here, so the differing items can be told apart
    left = _part_rubric(t).withColumns({"name": F.col("ord").cast("string"), "max_score": F.lit(10.0)})
    right = left.withColumn("max_score", F.when(F.col("ord") % 10 == 0, 11.0).otherwise(10.0))
    return B.rubric_diff(left, right).select("rubric_id", F.col("name").cast("bigint").alias("ord"), "side")


@query("b6_stale_results", """
SELECT o_orderkey AS report_id, c_custkey AS rubric_id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE left(sha256('v1||' || c_mktsegment), 16) <>
      left(sha256(CASE WHEN c_custkey % 4 = 0 THEN 'v2||' ELSE 'v1||' END || c_mktsegment), 16)""")
def b6(t):
    rubrics = t.raw("customer").select(F.col("c_custkey").alias("rubric_id"), B.rubric_hash(
        F.when(F.col("c_custkey") % 4 == 0, "v2").otherwise("v1"), F.col("c_mktsegment")).alias("source_hash"))
    at_grading = t.raw("customer").select("c_custkey", B.rubric_hash(F.lit("v1"), F.col("c_mktsegment")).alias("source_hash"))
    results = t.raw("orders").join(at_grading, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("rubric_id"), "source_hash")
    return B.stale_results(results, rubrics).select("report_id", "rubric_id")


# ---- redaction, hygiene, clipping --------------------------------------------------
W = r"\p{L}\p{N}_"
EMAIL = rf"[{W}.+-]+@[{W}-]+\.[{W}.]+"
SQUEEZED = f"trim(regexp_replace(regexp_replace({{}}, '[ \\t]{{{{3,}}}}', '  ', 'g'), '\\n{{{{4,}}}}', chr(10) || chr(10) || chr(10), 'g'), {WS})"


def squeezed(expr):
    return SQUEEZED.format(expr)


@query("r1_redact", rf"""
SELECT doc_id AS report_id, {squeezed(f"regexp_replace(text, '{EMAIL}', '【邮箱】', 'g')")} AS redacted,
       len(regexp_extract_all(text, '{EMAIL}')) AS mails FROM documents""")
def r1(t):
    out = R.redact(t.reports)
    return out.select("report_id", "redacted", F.coalesce(F.try_element_at("hits", F.lit("邮箱")), F.lit(0)).alias("mails"))


@query("r2_redact_names", """
SELECT doc_id AS report_id, replace(replace(text, 'eau', '【姓名】'), 'ung', '【姓名】') AS redacted,
       (length(text) - length(replace(text, 'eau', ''))) // 3 + (length(text) - length(replace(text, 'ung', ''))) // 3 AS name_hits
FROM documents""")
def r2(t):
    return R.redact_names(t.reports, ["eau", "ung"]).select("report_id", "redacted", "name_hits")


@query("r3_squeeze", f"""
SELECT page_id AS report_id, {squeezed("replace(html, '<', '   ' || chr(10))")} AS text FROM pages""")
def r3(t):
    spaced = F.replace(F.col("html"), F.lit("<"), F.lit("   \n"))
    return t.raw("pages").select(F.col("page_id").alias("report_id"), X.strip(R.squeeze(spaced)).alias("text"))


@query("r4_residual_pii", rf"""
SELECT doc_id AS report_id, '疑似邮箱' AS checker, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents
WHERE regexp_matches(text, '{EMAIL}')
UNION ALL SELECT doc_id, '疑似真姓名行', 1 FROM documents WHERE doc_id % 5 = 0""")
def r4(t):
    # every fifth text gets one placeholder line (ignored) and one real-looking one (counted)
    spiked = F.when(F.col("report_id") % 5 == 0, F.concat("raw_text", F.lit("\n姓名：【已脱敏】\n学号: X1"))).otherwise(F.col("raw_text"))
    return R.residual_pii(t.reports.withColumn("redacted", spiked))


# ids are text; every fifth text ends in a student number of one character, which redaction leaves and the residual scan finds
CORPUS = """corpus AS (
  SELECT 'r' || doc_id AS report_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || '学号: X' ELSE text END AS raw, doc_id % 5 = 0 AS spiked
  FROM documents)"""


def _corpus(t):
    raw = F.when(F.col("report_id") % 5 == 0, F.concat("raw_text", F.lit("\n学号: X"))).otherwise(F.col("raw_text"))
    return t.reports.select(F.concat(F.lit("r"), F.col("report_id").cast("string")).alias("report_id"), raw.alias("raw_text"),
                            F.concat(F.lit("/in/"), "class_id", F.lit("/"), F.col("report_id").cast("string"), F.lit(".txt")).alias("path"))


@query("r5_anonymize_corpus", with_(CORPUS, f"long_ AS (SELECT *, row_number() OVER (ORDER BY report_id) AS i FROM corpus WHERE length(trim(raw, {WS})) >= 100)") + rf"""
SELECT report_id, CASE WHEN i < 100 THEN 'S' || lpad(CAST(i AS VARCHAR), 2, '0') ELSE 'S' || i END AS anonymous_id,
       substr(report_id, 2) || '.txt' AS original, length({squeezed(f"regexp_replace(raw, '{EMAIL}', '【邮箱】', 'g')")}) AS chars,
       len(regexp_extract_all(raw, '{EMAIL}')) AS mails, CASE WHEN spiked THEN 1 ELSE 0 END AS residual
FROM long_""")
def r5(t):
    def count(column, label):
        return F.coalesce(F.try_element_at(column, F.lit(label)), F.lit(0))

    return R.anonymize_corpus(_corpus(t)).select(
        "report_id", "anonymous_id", "original", "chars", count("hits", "邮箱").alias("mails"), count("residual", "疑似真姓名行").alias("residual"))


@query("r5_rejected_reports", with_(CORPUS) + f"""
SELECT report_id, substr(report_id, 2) || '.txt' AS original, length(raw) AS chars, 'too_short' AS reason
FROM corpus WHERE length(trim(raw, {WS})) < 100""")
def r5b(t):
    return R.rejected_reports(_corpus(t))


TOKEN = K.HYGIENE_PATTERNS[0][1]


@query("r6_hygiene_scan", rf"""
WITH files AS (
  SELECT 'doc/' || doc_id || '.txt' AS path, replace(text, 'token = "', 'sk-' ) AS text FROM documents
  UNION ALL SELECT 'page/' || page_id || '.html', html FROM pages),
hits AS (
  SELECT path, '密钥串' AS type, regexp_extract(text, '{TOKEN}') AS hit,
         regexp_extract(text, '(?s)^(.*?)(?:{TOKEN})', 1) AS before FROM files WHERE regexp_matches(text, '{TOKEN}')
  UNION ALL
  SELECT path, '疑似学号', regexp_extract(text, '(?:^|\D)(\d{{10}})(?:\D|$)', 1),
         regexp_extract(text, '(?s)^(.*?(?:^|\D))\d{{10}}(?:\D|$)', 1)
  FROM files WHERE regexp_matches(text, '(?:^|\D)(\d{{10}})(?:\D|$)')
  UNION ALL
  SELECT path, '手机号', regexp_extract(text, '(?:^|\D)(1[3-9]\d{{9}})(?:\D|$)', 1),
         regexp_extract(text, '(?s)^(.*?(?:^|\D))1[3-9]\d{{9}}(?:\D|$)', 1)
  FROM files WHERE regexp_matches(text, '(?:^|\D)(1[3-9]\d{{9}})(?:\D|$)'))
SELECT path, type, length(before) - length(replace(before, chr(10), '')) + 1 AS line, left(hit, 40) AS snippet FROM hits""")
def r6(t):
    docs = t.reports.select(F.concat(F.lit("doc/"), F.col("report_id").cast("string"), F.lit(".txt")).alias("path"),
                            F.replace("raw_text", F.lit('token = "'), F.lit("sk-")).alias("text"))
    pages = t.raw("pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
                                  F.col("html").alias("text"))
    return R.hygiene_scan(docs.unionByName(pages))


@query("r7_mask_secrets", r"""
SELECT doc_id AS report_id,
       regexp_replace(replace(replace(text, 'token = "', ' sk-'), 'ithout-', 'ith********'), '(sk|ak)-[A-Za-z0-9_\-]{8,}', '\1-********', 'g') AS text
FROM documents""")
def r7(t):
    keyed = F.replace("raw_text", F.lit('token = "'), F.lit(" sk-"))
    return t.reports.select("report_id", R.mask_secrets(keyed, ["ithout-"]).alias("text"))


SPANS = """spans AS (
  SELECT report_id, greatest(strpos(full_text, q) - 1 - 100, 0) AS a,
         least(strpos(full_text, q) - 1 + length(q) + 100, length(full_text)) AS b
  FROM (SELECT report_id, full_text, unnest(evidence) AS q FROM attempts)
  WHERE strpos(full_text, q) > 0 AND length(q) >= 6),
chained AS (
  SELECT *, coalesce(max(b) OVER (PARTITION BY report_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach
  FROM spans),
grouped AS (SELECT *, sum((a > reach)::INT) OVER (PARTITION BY report_id ORDER BY a, b) AS g FROM chained),
merged AS (SELECT report_id, g, min(a) AS a, max(b) AS b FROM grouped GROUP BY 1, 2)"""


def _spans_quotes(t):
    return t.attempts.select("report_id", F.explode("evidence").alias("quote"))


@query("r8_evidence_windows", with_(TEXTS, ATTEMPTS, SPANS) + "SELECT report_id, a, b FROM merged")
def r8(t):
    out = R.evidence_windows(t.texts, _spans_quotes(t), 100)
    return out.select("report_id", F.inline_outer("spans")).where("a is not null")


@query("r8_clip_public_text", with_(TEXTS, ATTEMPTS, SPANS, """budgeted AS (
  SELECT *, coalesce(sum(b - a) OVER (PARTITION BY report_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM merged),
clips AS (
  SELECT report_id, string_agg(CASE WHEN m.a > 0 THEN '……' ELSE '' END
           || substr(full_text, m.a + 1, CAST(least(m.b - m.a, 600 - used) AS BIGINT)) || '……', chr(10) || chr(10) ORDER BY m.a) AS clip
  FROM budgeted m JOIN texts USING (report_id) WHERE used < 600 GROUP BY report_id)""") + """
SELECT report_id, coalesce(clip, left(full_text, 600) || chr(10) || chr(10) || '……（未命中任何证据片段，仅展示报告开头）') AS public_text
FROM texts LEFT JOIN clips USING (report_id)""")
def r8b(t):
    return R.clip_public_text(t.texts, _spans_quotes(t), 100, 600).select("report_id", "public_text")


@query("r9_check_public", rf"""
SELECT doc_id AS report_id, 'not_marked_public' AS problem FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id, 'over_size_cap' FROM documents WHERE length(text) > 6500
UNION ALL SELECT doc_id, '疑似邮箱' FROM documents WHERE regexp_matches(text, '{EMAIL}')""")
def r9(t):
    return R.check_public(t.reports.select("report_id", F.col("raw_text").alias("public_text"),
                                           (F.col("report_id") % 9 != 0).alias("is_public")))


@query("r10_safe_name", r"""
SELECT doc_id AS report_id, coalesce(nullif(left(trim(regexp_replace(text, '[^0-9A-Za-z一-鿿_\-]+', '', 'g'), '-_'), 60), ''),
       '未命名报告') AS name FROM documents""")
def r10(t):
    return t.reports.select("report_id", R.safe_name(F.col("raw_text")).alias("name"))
