"""Gold comparison, quality metrics and repeatability queries."""

from pyspark.sql import functions as F

from ..operators import chain as CH
from ..operators import classview as C
from ..operators import evidence as EV
from ..operators import judge as J
from ..operators import metrics as M
from ..operators import stability as P
from .catalog import query
from .fixtures import ATTEMPTS, DETAILS, FIRST, GOLD, ITEM_MAX, RESULTS, RUNS, SHEET, TEXTS, VERIFIED, with_

COMPARED = """ai AS (SELECT report_id, sum(score_c) AS ai_c FROM firsts GROUP BY report_id),
compared AS (
  SELECT g.report_id, g.batch_id, g.gold, round_even(ai_c / 100.0, 1) AS ai, ai_c,
         round_even(ai_c / 100.0, 1) - g.gold AS diff FROM gold g LEFT JOIN ai USING (report_id))"""
# item scores of the fixture are tenths of a point, so no rounding ever happens here
COMPARED = COMPARED.replace("round_even(ai_c / 100.0, 1) - g.gold", "(ai_c - 100 * g.gold) / 100.0").replace(
    "round_even(ai_c / 100.0, 1)", "ai_c / 100.0")
CMP = with_(DETAILS, FIRST, GOLD, COMPARED)
MAE = """mae AS (
  SELECT batch_id, count(ai_c) AS n, sum(abs(ai_c - 100 * gold)) / 100.0 / count(ai_c) AS mae,
         100 * count(*) FILTER (abs(ai_c - 100 * gold) <= 500) / count(ai_c) AS within
  FROM compared GROUP BY batch_id)"""
PEARSON = """pairs AS (SELECT batch_id, gold * 100 AS x, ai_c AS y FROM compared WHERE ai_c IS NOT NULL),
moments AS (
  SELECT batch_id, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy,
         CAST(sum(x * y) AS DOUBLE) AS sxy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy
  FROM pairs GROUP BY batch_id),
corr AS (
  SELECT batch_id, n, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS pearson
  FROM moments)"""
GOLD_ITEMS = """gold_items AS (
  SELECT report_id, item_id, CASE WHEN score_c / 100 % 10 = 0 THEN '' WHEN score_c * 10 > max_c * 7 THEN 'hit'
         WHEN score_c * 10 > max_c * 3 THEN 'partial' ELSE 'miss' END AS verdict FROM firsts)"""
AGREEMENT = """agree AS (
  SELECT class_id AS batch_id, count(*) AS compared, count(*) FILTER (f.verdict = g.verdict) AS agreed,
         100 * count(*) FILTER (f.verdict = g.verdict) / count(*) AS agreement
  FROM firsts f JOIN gold_items g USING (report_id, item_id) WHERE g.verdict <> '' GROUP BY class_id)"""


def _first(t):
    return C.first_judgement(t.details)


def _compared(t):
    return M.compare_totals(t.gold_totals, J.report_totals(_first(t)))


def _gold_items(t, judged):
    tenth = F.col("score") * 10
    verdict = (F.when(F.col("score").cast("double") % 10 == 0, "").when(tenth > F.col("max_score") * 7, "hit")
               .when(tenth > F.col("max_score") * 3, "partial").otherwise("miss"))
    return judged.select("report_id", "item_id", "score", verdict.alias("verdict"))


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("m1_import_gold", with_(SHEET) + """
SELECT 'item' AS kind, CAST(m.report_id AS VARCHAR) AS report_id, m.item_id, m.score || ' ' || m.verdict AS info
FROM marked m JOIN state USING (report_id) WHERE filled = 5
UNION ALL SELECT 'excluded', CAST(report_id AS VARCHAR), '', '' FROM state WHERE filled = 0 AND blanks > 0
UNION ALL SELECT 'problem', CAST(report_id AS VARCHAR), item_id, problem FROM marked WHERE problem IS NOT NULL
UNION ALL SELECT 'problem', CAST(report_id AS VARCHAR), '', 'partly_filled' FROM state WHERE filled BETWEEN 1 AND 4
UNION ALL SELECT 'total', CAST(report_id AS VARCHAR), '', CAST(sum(CAST(m.score AS INTEGER)) AS VARCHAR)
          FROM marked m JOIN state USING (report_id) WHERE filled = 5 GROUP BY report_id
UNION ALL SELECT 'problem', '', '', 'no_complete_report' FROM state HAVING count(*) FILTER (filled = 5) = 0""")
def m1(t):
    got = M.import_gold(t.sheet, t.one_rubric)
    items = got.items.select(F.lit("item").alias("kind"), "report_id", "item_id", F.concat_ws(
        " ", F.col("score").cast("int").cast("string"), "verdict").alias("info"))
    excluded = got.excluded.select(F.lit("excluded").alias("kind"), "report_id", F.lit("").alias("item_id"),
                                   F.lit("").alias("info"))
    problems = got.problems.select(F.lit("problem").alias("kind"), "report_id", "item_id", F.col("problem").alias("info"))
    totals = got.totals.select(F.lit("total").alias("kind"), "report_id", F.lit("").alias("item_id"), F.col("total").cast("int").cast("string").alias("info"))
    return items.unionByName(excluded).unionByName(problems).unionByName(totals)


@query("m2_check_seal", """
WITH keys AS (SELECT unnest([1, 2, 3, 4]) AS k),
seal AS (
  SELECT c_custkey AS dataset_id, k, CASE WHEN (c_custkey + k) % 9 = 0 THEN '' WHEN (c_custkey + k) % 7 = 0 THEN '否'
         ELSE '是' END AS value FROM customer CROSS JOIN keys WHERE (c_custkey + k) % 11 <> 0)
SELECT c_custkey AS dataset_id,
       ['打分人姓名', '打分日期', '是否独立完成（未与主程讨论）', '是否全程未参考 AI 评分'][k] AS key,
       CASE WHEN coalesce(value, '') = '' THEN 'missing' ELSE 'not_independent' END AS problem
FROM customer CROSS JOIN keys LEFT JOIN seal s ON s.dataset_id = c_custkey AND s.k = keys.k
WHERE coalesce(value, '') = '' OR (keys.k >= 3 AND value <> '是')""".replace("[k] AS key", "[keys.k] AS key"))
def m2(t):
    from ..constants import SEAL_REQUIRED
    k, key = F.col("k"), F.col("c_custkey")
    seal = t.raw("customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).where(
        (key + k) % 11 != 0).select(
        key.alias("dataset_id"), F.element_at(F.array(*[F.lit(s) for s in SEAL_REQUIRED]), k).alias("key"),
        F.when((key + k) % 9 == 0, "").when((key + k) % 7 == 0, "否").otherwise("是").alias("value"))
    return M.check_seal(seal)


GOLD_LINES = """lines AS (
  SELECT doc_id % 7 AS dataset_id, CAST(doc_id AS VARCHAR) AS rid, doc_id || ':' || CAST(CAST(quality + toxic AS DOUBLE) AS VARCHAR) || '|' || doc_id || '/quality='
         || CAST(CAST(quality AS DOUBLE) AS VARCHAR) || '|' || doc_id || '/toxic=' || CAST(CAST(toxic AS DOUBLE) AS VARCHAR) AS line FROM labels)"""


def _gold_sets(t):
    """The labels as gold items of seven sets."""
    return t.raw("labels").select((F.col("doc_id") % 7).alias("dataset_id"), F.col("doc_id").alias("report_id"), F.inline(F.array(
        F.struct(F.lit("toxic").alias("item_id"), F.col("toxic").cast("decimal(9,2)").alias("score")),
        F.struct(F.lit("quality").alias("item_id"), F.col("quality").cast("decimal(9,2)").alias("score")))))


@query("m3_score_fingerprint", with_(GOLD_LINES, """leaves AS (SELECT dataset_id, sha256(rid) AS place, sha256(line) AS d FROM lines),
low AS (SELECT dataset_id, left(place, 6) AS place, count(*) AS n, sha256(string_agg(d, '' ORDER BY place)) AS d FROM leaves GROUP BY dataset_id, left(place, 6)),
high AS (SELECT dataset_id, left(place, 3) AS place, sum(n) AS n, sha256(string_agg(d, '' ORDER BY place)) AS d FROM low GROUP BY dataset_id, left(place, 3))""") + """
SELECT dataset_id, CAST(sum(n) AS BIGINT) AS reports, left(sha256(string_agg(d, '' ORDER BY place)), 16) AS fingerprint FROM high GROUP BY dataset_id""")
def m3(t):
    return M.score_fingerprint(_gold_sets(t))


@query("m3_published_fingerprint", with_(GOLD_LINES) + """
SELECT dataset_id, count(*) AS reports, left(sha256(string_agg(line, '|' ORDER BY rid)), 16) AS fingerprint FROM lines GROUP BY dataset_id""")
def m3b(t):
    return M.published_fingerprint(_gold_sets(t))


@query("m4_gold_diff", """
WITH a AS (SELECT doc_id, quality AS s FROM labels WHERE doc_id % 7 <> 0),
     b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS s FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS report_id, 'quality' AS item_id,
       CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right' ELSE 'changed' END AS difference
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.s IS DISTINCT FROM b.s""")
def m4(t):
    def gold(score, keep):
        return t.raw("labels").where(keep).select(
            F.col("doc_id").alias("report_id"), F.lit("quality").alias("item_id"), score.alias("score"),
            score.cast("string").alias("verdict"))
    left = gold(F.col("quality"), F.col("doc_id") % 7 != 0)
    right = gold(F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality")), F.col("doc_id") % 11 != 0)
    return M.gold_diff(left, right)


@query("m5_compare_totals", CMP + """
SELECT report_id, CAST(gold AS DOUBLE) AS gold, coalesce(ai, -1) AS ai, coalesce(diff, -999) AS diff,
       CASE WHEN ai IS NULL THEN 'not_evaluated' ELSE 'compared' END AS status FROM compared""")
def m5(t):
    out = _doubles(_compared(t), "gold", "ai", "diff")
    return out.select("report_id", "gold", F.coalesce("ai", F.lit(-1.0)).alias("ai"),
                      F.coalesce("diff", F.lit(-999.0)).alias("diff"), "status")


@query("m6_mae_within", CMP.rstrip() + ",\n" + MAE + "\nSELECT * FROM mae")
def m6(t):
    return M.mae_within(_compared(t))


@query("m7_pearson", CMP.rstrip() + ",\n" + PEARSON + "\nSELECT batch_id, n, round(pearson, 9) AS pearson FROM corr")
def m7(t):
    return M.pearson(_compared(t)).withColumn("pearson", F.round("pearson", 9))


@query("m8_item_agreement", with_(DETAILS, FIRST, GOLD_ITEMS, AGREEMENT) + "SELECT * FROM agree")
def m8(t):
    judged = _first(t)
    return M.item_agreement(_gold_items(t, judged), judged.withColumnRenamed("class_id", "batch_id"))


@query("m9_traceability", with_(TEXTS, ATTEMPTS, """quotes AS (
  SELECT 'attempt ' || attempt_no AS batch_id, full_text, unnest(evidence) AS q FROM attempts)""") + """
SELECT batch_id, count(*) AS checked, count(*) FILTER (length(q) BETWEEN 6 AND 200 AND contains(full_text, q)) AS ok,
       100 * count(*) FILTER (length(q) BETWEEN 6 AND 200 AND contains(full_text, q)) / count(*) AS rate
FROM quotes WHERE q <> '' GROUP BY batch_id""")
def m9(t):
    quotes = t.attempts.select(F.concat(F.lit("attempt "), F.col("attempt_no").cast("string")).alias("batch_id"),
                               "report_id", F.explode("evidence").alias("quote"))
    return M.traceability(quotes, t.texts)


COST = """cost AS (
  SELECT f.class_id AS batch_id, count(*) AS judged, 100 * count(*) FILTER (needs_review) / count(*) AS review_rate,
         100 * count(*) FILTER (system_error <> '') / count(*) AS system_error_rate
  FROM firsts f GROUP BY f.class_id),
spent AS (
  SELECT 'c' || (o_orderkey % 25) AS batch_id, sum(o_custkey % 60) AS latency_sum,
         sum(o_custkey % 60) / count(*) AS latency_avg, sum(o_custkey * 10) AS tokens
  FROM orders GROUP BY 1)"""


def _spent(t):
    return t.raw("orders").select(
        F.concat(F.lit("c"), F.pmod("o_orderkey", F.lit(25)).cast("string")).alias("batch_id"),
        (F.col("o_custkey") % 60).alias("elapsed_sec"), (F.col("o_custkey") * 10).alias("tokens"))


@query("m10_cost_and_review", with_(DETAILS, FIRST, COST) + """
SELECT batch_id, judged, review_rate, system_error_rate, CAST(latency_sum AS BIGINT) AS latency_sum, latency_avg,
       CAST(tokens AS BIGINT) AS tokens FROM cost JOIN spent USING (batch_id)""")
def m10(t):
    return M.cost_and_review(_first(t).withColumnRenamed("class_id", "batch_id"), _spent(t))


DISC = """disc AS (
  SELECT batch_id, count(total_d) AS n, max(total_d) / 10.0 AS max, min(total_d) / 10.0 AS min,
         (max(total_d) - min(total_d)) / 10.0 AS range,
         sqrt(CAST(count(total_d) * sum(total_d * total_d) - sum(total_d) * sum(total_d) AS DOUBLE))
           / count(total_d) / 10 AS stdev,
         count(*) FILTER (total_d >= 1000) AS perfect_count,
         100 * count(*) FILTER (total_d >= 1000) / count(total_d) AS perfect_ratio
  FROM results GROUP BY batch_id)"""


@query("m11_discrimination", with_(RESULTS, DISC) + "SELECT * REPLACE (round(stdev, 9) AS stdev) FROM disc")
def m11(t):
    return M.discrimination(t.results).withColumn("stdev", F.round("stdev", 9))


@query("m12_benchmark_report", with_(DETAILS, FIRST, GOLD.replace("o_orderpriority", "'c' || (o_orderkey % 25)"),
                                     COMPARED, MAE, PEARSON, GOLD_ITEMS, AGREEMENT, COST) + """
SELECT m.batch_id, m.n AS reports, mae, within, round(pearson, 9) AS pearson, agreement, review_rate, system_error_rate,
       CAST(s.tokens AS BIGINT) AS tokens, u.not_evaluated, u.range
FROM mae m JOIN corr USING (batch_id) JOIN agree USING (batch_id) JOIN cost USING (batch_id)
JOIN spent s USING (batch_id)
JOIN (SELECT batch_id, count(*) FILTER (ai IS NULL) AS not_evaluated, (max(ai_c) - min(ai_c)) / 100.0 AS range
      FROM compared GROUP BY 1) u USING (batch_id)""")
def m12(t):
    judged = _first(t)
    by_batch = judged.withColumnRenamed("class_id", "batch_id")
    gold = t.gold_totals.withColumn("batch_id", F.concat(F.lit("c"), F.pmod("report_id", F.lit(25)).cast("string")))
    compared = M.compare_totals(gold, J.report_totals(judged))
    out = M.benchmark_report(compared, M.item_agreement(_gold_items(t, judged), by_batch),
                             M.cost_and_review(by_batch, _spent(t)))
    return out.select("batch_id", "reports", "mae", "within", F.round("pearson", 9).alias("pearson"), "agreement",
                      "review_rate", "system_error_rate", "tokens", "not_evaluated", "range")


@query("m13_batch_spread", with_(RESULTS) + """
SELECT batch_id, count(*) AS n, min(total_d) / 10.0 AS lowest, max(total_d) / 10.0 AS highest,
       (max(total_d) - min(total_d)) / 10.0 AS range, max(total_d) - min(total_d) >= 150 AS separates
FROM results WHERE total_d IS NOT NULL GROUP BY batch_id""")
def m13(t):
    return M.batch_spread(t.results)


@query("m13_sorted_totals", with_(RESULTS) + """
SELECT batch_id, report_id, total_d / 10.0 AS total FROM results WHERE total_d IS NOT NULL""")
def m13b(t):
    return M.sorted_totals(t.results).withColumn("total", F.col("total").cast("double"))


@query("m14_batch_matrix", with_(DETAILS, FIRST, RESULTS, GOLD) + """
SELECT r.report_id, length(name) AS chars, coalesce(total_d / 10.0, -1) AS total, coalesce(nr, -1) AS needs_review,
       """ + ", ".join(f"coalesce(r{k} / 100.0, -1) AS r{k}" for k in range(1, 8)) + """,
       coalesce(CAST(gold AS DOUBLE), -1) AS gold, coalesce((total_d - 10 * gold) / 10.0, -999) AS diff
FROM results r LEFT JOIN (
  SELECT report_id, count(*) FILTER (needs_review) AS nr,
         """ + ", ".join(f"max(score_c) FILTER (item_id = 'r{k}') AS r{k}" for k in range(1, 8)) + """
  FROM firsts GROUP BY report_id) w USING (report_id) LEFT JOIN gold USING (report_id)""")
def m14(t):
    items = [f"r{k}" for k in range(1, len(ITEM_MAX) + 1)]
    out = _doubles(M.batch_matrix(_first(t), items, t.results.withColumn("chars", F.length("name")), t.gold_totals), "total", "gold", "diff", *items)
    return out.select("report_id", "chars", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("total", "gold", *items)],
                      F.coalesce("needs_review", F.lit(-1)).alias("needs_review"),
                      F.coalesce("diff", F.lit(-999.0)).alias("diff"))


@query("m15_admit_batch", """
SELECT doc_id AS report_id, n_chars AS chars, n_chars <= 5000 AS admitted,
       CASE WHEN n_chars > 5000 THEN 'too_long' ELSE '' END AS reason
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def m15(t):
    reports = t.raw("documents").select(F.col("doc_id").alias("report_id"), F.col("n_chars").alias("chars"))
    chosen = t.raw("labels").select(F.col("doc_id").alias("report_id"))
    return M.admit_batch(reports, limit=5000, only=chosen)


# ---- repeatability -----------------------------------------------------------------
SHARES = """dist AS (
  SELECT report_id, item_id, verdict, count(*) AS n FROM runs WHERE error = '' GROUP BY ALL),
shares AS (SELECT report_id, item_id, sum(n) AS runs, max(n) / sum(n) AS stability FROM dist GROUP BY ALL)"""


@query("p1_verdict_stability", with_(RUNS, SHARES) + """
SELECT report_id, count(*) AS items, round(sum(stability ORDER BY item_id) / count(*), 9) AS stability
FROM shares GROUP BY report_id""")
def p1(t):
    return P.verdict_stability(t.runs).withColumn("stability", F.round("stability", 9))


@query("p2_score_spread", with_(RUNS) + """
SELECT report_id, item_id, count(score) AS runs, CAST(max(score) - min(score) AS DOUBLE) AS score_range,
       round(sqrt(CAST(count(score) * sum(score * score) - sum(score) * sum(score) AS DOUBLE)) / count(score), 9) AS score_stdev
FROM runs WHERE error = '' GROUP BY ALL""")
def p2(t):
    return P.score_spread(t.runs).withColumn("score_stdev", F.round("score_stdev", 9))


@query("p3_total_spread", with_(RUNS, """best AS (
  SELECT *, max(score) OVER (PARTITION BY report_id) AS top FROM runs WHERE error = '')""") + """
SELECT report_id, count(*) AS runs, CAST(max(score) - min(score) AS DOUBLE) AS total_range,
       count(*) FILTER (score = top) AS at_max
FROM best GROUP BY report_id""")
def p3(t):
    return P.total_spread(t.runs)


@query("p4_verdict_distribution", with_(RUNS, SHARES) + "SELECT * FROM dist")
def p4(t):
    return P.verdict_distribution(t.runs)


@query("p5_stability_gate", with_(TEXTS, ATTEMPTS, RUNS, """rates AS (
  SELECT report_id, count(*) FILTER (length(q) >= 6 AND contains(full_text, q)) / count(*) AS quote_rate
  FROM (SELECT report_id, full_text, unnest(evidence) AS q FROM attempts) GROUP BY report_id),
valid AS (SELECT report_id, count(*) FILTER (error = '') / count(*) AS valid_rate FROM runs GROUP BY report_id)""") + """
SELECT report_id, valid_rate, coalesce(quote_rate, 0) AS quote_rate,
       valid_rate >= 0.9 AND coalesce(quote_rate, 0) >= 0.9 AS passed
FROM valid LEFT JOIN rates USING (report_id)""")
def p5(t):
    return P.stability_gate(t.runs, CH.quote_rates(t.texts, t.attempts))


@query("p6_failed_runs", with_(RUNS) + """
SELECT report_id, error, count(*) AS n FROM runs WHERE error <> '' GROUP BY ALL""")
def p6(t):
    return P.failed_runs(t.runs)
