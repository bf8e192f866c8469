"""Class view queries on the lineitem / orders views."""

from pyspark.sql import functions as F

from ..operators import classview as C
from .catalog import query
from .fixtures import DETAILS, FIRST, RESULTS, with_

ITEMS = """items AS (
  SELECT class_id, item_id, arg_min(item_name, (report_id, pos)) AS item_name,
         row_number() OVER (PARTITION BY class_id ORDER BY min((report_id, pos)), item_id) AS item_ord
  FROM details GROUP BY class_id, item_id)"""
STATS = """judged AS (
  SELECT class_id, item_id, count(*) AS counted, count(*) FILTER (verdict = 'hit') AS hit,
         count(*) FILTER (verdict = 'partial') AS partial, sum(score_c) AS s, sum(max_c) AS m,
         arg_min(max_c, report_id) AS max_c, count(*) FILTER (needs_review) AS needs_review
  FROM firsts WHERE system_error = '' GROUP BY class_id, item_id),
stats AS (
  SELECT i.class_id, i.item_ord, i.item_id, i.item_name, counted, hit, partial, counted - hit - partial AS miss,
         counted - hit AS weak, (counted - hit) / counted AS weak_ratio,
         (counted - hit - partial) / counted AS miss_ratio, s / 100.0 / counted AS avg_score,
         max_c / 100.0 AS max_score, (s / 100.0) / (m / 100.0) AS avg_ratio, needs_review
  FROM items i JOIN judged j USING (class_id, item_id))"""
TOTALS = """totals AS (
  SELECT r.class_id, count(*) AS n_reports, count(*) FILTER (NOT total_incomplete) AS n_scored,
         count(*) FILTER (total_incomplete) AS n_incomplete,
         count(*) FILTER (coverage = 'retrieved') AS n_retrieved,
         sum(coalesce(total_d, 0)) FILTER (NOT total_incomplete) / 10.0 / count(*) FILTER (NOT total_incomplete) AS mean,
         max(coalesce(total_d, 0)) FILTER (NOT total_incomplete) / 10.0 AS max,
         min(coalesce(total_d, 0)) FILTER (NOT total_incomplete) / 10.0 AS min,
         (max(coalesce(total_d, 0)) FILTER (NOT total_incomplete)
          - min(coalesce(total_d, 0)) FILTER (NOT total_incomplete)) / 10.0 AS range,
         100 * count(*) FILTER (NOT total_incomplete AND total_d >= 600)
           / count(*) FILTER (NOT total_incomplete) AS pass_rate,
         100 * count(*) FILTER (NOT total_incomplete AND total_d >= 850)
           / count(*) FILTER (NOT total_incomplete) AS excellent_rate
  FROM results r GROUP BY r.class_id)"""
REVIEWS = """full_totals AS (
  SELECT t.*, coalesce(v.n, 0) AS needs_review_total FROM totals t
  LEFT JOIN (SELECT class_id, CAST(sum(needs_review) AS BIGINT) AS n FROM stats GROUP BY class_id) v USING (class_id))"""
STUDENTS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class_id, report_id ORDER BY (score_c / 100.0) / (max_c / 100.0), pos) AS rn
  FROM details WHERE system_error = '' AND verdict IN ('miss', 'partial')),
students AS (
  SELECT r.class_id, r.report_id, r.name, r.total_d, r.total_incomplete AS incomplete, r.coverage,
         coalesce(a.nr, 0) AS needs_review, coalesce(w.item_name, '') AS weakest,
         coalesce((w.max_c - w.score_c) / 100.0, 0) AS weakest_gap, coalesce(a.mc, 0) AS miss_count
  FROM results r
  LEFT JOIN (SELECT class_id, report_id, count(*) FILTER (needs_review) AS nr,
                    count(*) FILTER (verdict = 'miss') AS mc
             FROM details WHERE system_error = '' GROUP BY 1, 2) a USING (class_id, report_id)
  LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) w USING (class_id, report_id))"""
S = with_(DETAILS, FIRST, ITEMS, STATS)
T = with_(DETAILS, FIRST, ITEMS, STATS, RESULTS, TOTALS, REVIEWS)
ST = with_(DETAILS, RESULTS, STUDENTS)


def _stats(t):
    return C.class_item_stats(t.details)


def _totals(t):
    return C.class_totals(t.results, _stats(t))


def _students(t):
    return C.student_rows(t.details, t.results)


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# the reports of a batch lie in another order than their ids
SHUFFLED = "(report_id * 7919) % 1000003"


@query("c1_class_items", with_(DETAILS, ITEMS.replace("(report_id, pos)", f"({SHUFFLED}, report_id, pos)")) + "SELECT class_id, item_id, item_name, item_ord FROM items")
def c1(t):
    return C.class_items(t.details.withColumn("report_ord", F.expr(f"{SHUFFLED} * 100000000000L + report_id").cast("bigint")))


@query("c2_first_judgement", with_(DETAILS, FIRST) + """
SELECT class_id, report_id, item_id, pos, verdict, score_c / 100.0 AS score FROM firsts""")
def c2(t):
    return _doubles(C.first_judgement(t.details).select(
        "class_id", "report_id", "item_id", "pos", "verdict", "score"), "score")


@query("c3_countable", with_(DETAILS) + """
SELECT class_id, verdict, count(*) AS n, sum(score_c) / 100.0 AS score FROM details WHERE system_error = ''
GROUP BY 1, 2""")
def c3(t):
    return _doubles(C.countable(t.details).groupBy("class_id", "verdict").agg(
        F.count("*").alias("n"), F.sum("score").alias("score")), "score")


@query("c4_class_item_stats", S + "SELECT * FROM stats")
def c4(t):
    return _doubles(_stats(t), "max_score")


@query("c5_class_totals", T + "SELECT * FROM full_totals")
def c5(t):
    return _totals(t)


@query("c6_score_histogram", with_(RESULTS) + """
SELECT class_id, bin_ord, label, count(*) FILTER (
         NOT total_incomplete AND coalesce(total_d, 0) >= lo AND coalesce(total_d, 0) < hi) AS count
FROM results CROSS JOIN (VALUES (0, '<60', 0, 600), (1, '60-70', 600, 700), (2, '70-80', 700, 800),
                                (3, '80-90', 800, 900), (4, '90-100', 900, 100000)) b(bin_ord, label, lo, hi)
GROUP BY ALL""")
def c6(t):
    return C.score_histogram(t.results)


@query("c7_student_rows", ST + """
SELECT class_id, report_id, name, coalesce(total_d / 10.0, -1) AS total, incomplete, coverage, needs_review,
       weakest, weakest_gap, miss_count FROM students""")
def c7(t):
    out = C.order_students(_students(t))
    return out.withColumn("total", F.coalesce(F.col("total").cast("double"), F.lit(-1.0)))


@query("c8_rank_weak_items", S + """
SELECT class_id, item_id, weak, counted, weak_ratio,
       row_number() OVER (PARTITION BY class_id ORDER BY weak_ratio DESC, item_ord) AS weak_rank
FROM stats WHERE counted > 0""")
def c8(t):
    return C.rank_weak_items(_stats(t)).select("class_id", "item_id", "weak", "counted", "weak_ratio", "weak_rank")


@query("c9_actions_teaching", S + """
SELECT class_id, item_id, weak, miss, counted, weak_ratio, avg_score, max_score FROM stats
WHERE weak_ratio >= 0.5""")
def c9(t):
    return C.actions_teaching(_stats(t)).select(
        "class_id", "item_id", "weak", "miss", "counted", "weak_ratio", "avg_score", "max_score")


# the fixture's verdicts are near uniform, so these two are asked per report group, where extremes occur
SMALL = DETAILS.replace("(l_orderkey % 25)", "(l_orderkey % 3000)")
SMALL_RESULTS = RESULTS.replace("(o_orderkey % 25)", "(o_orderkey % 3000)")


def _small(df):
    return df.withColumn("class_id", F.concat(F.lit("c"), F.pmod("report_id", F.lit(3000)).cast("string")))


@query("c10_actions_brief", with_(SMALL, FIRST, ITEMS, STATS) + """
SELECT class_id, item_id, miss, counted, miss_ratio FROM stats WHERE miss_ratio >= 0.5""")
def c10(t):
    return C.actions_brief(C.class_item_stats(_small(t.details))).select(
        "class_id", "item_id", "miss", "counted", "miss_ratio")


@query("c11_actions_rubric", with_(SMALL, FIRST, ITEMS, STATS, SMALL_RESULTS, TOTALS) + """
SELECT class_id, item_id, hit, counted FROM stats JOIN totals USING (class_id)
WHERE hit = counted AND counted >= greatest(3, n_scored // 2)""")
def c11(t):
    stats = C.class_item_stats(_small(t.details))
    return C.actions_rubric(stats, C.class_totals(_small(t.results))).select("class_id", "item_id", "hit", "counted")


@query("c12_actions_review", T + """
SELECT class_id, needs_review_total AS pending FROM full_totals WHERE needs_review_total > 0""")
def c12(t):
    return C.actions_review(_totals(t)).select("class_id", "pending")


@query("c13_class_notes", with_(SMALL_RESULTS, TOTALS) + """
SELECT class_id, n_scored > 0 AS ok, CASE WHEN n_scored > 0 THEN '' ELSE 'no_scored_reports' END AS reason,
       CASE WHEN n_scored = 0 THEN '' ELSE concat_ws('|',
         CASE WHEN n_scored < 8 THEN 'small_sample:' || n_scored END,
         CASE WHEN n_incomplete > 0 THEN 'incomplete:' || n_incomplete END,
         CASE WHEN n_retrieved > 0 THEN 'recall_mode:' || n_retrieved END) END AS notes
FROM totals""")
def c13(t):
    return C.class_notes(C.class_totals(_small(t.results))).withColumn("notes", F.array_join("notes", "|"))


@query("c14_focus_students", ST + """
SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY total_d, report_id) AS rank, report_id, name,
       total_d / 10.0 AS total, weakest, weakest_gap
FROM students WHERE total_d < 600 QUALIFY rank <= 8""")
def c14(t):
    return _doubles(C.focus_students(_students(t)), "total")


@query("c15_exemplars", ST + """
SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY total_d DESC, report_id) AS rank, report_id, name,
       total_d / 10.0 AS total
FROM students WHERE total_d IS NOT NULL AND NOT incomplete AND miss_count = 0 AND needs_review = 0
QUALIFY rank <= 3""")
def c15(t):
    return _doubles(C.exemplars(_students(t)), "total")


QUIET_STUDENTS = """rows_ AS (
  SELECT *, (coalesce(total_d < 600, false) OR incomplete OR needs_review > 0) AS flagged FROM students),
graded AS (
  SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY total_d NULLS LAST, report_id) AS rn,
         count(*) FILTER (flagged) OVER (PARTITION BY class_id) AS n_flagged
  FROM rows_)"""


@query("c16_attention_list", with_(SMALL, SMALL_RESULTS, STUDENTS, QUIET_STUDENTS) + """
SELECT class_id, report_id, flagged, weakest, miss_count FROM graded
WHERE flagged OR (n_flagged = 0 AND rn <= 10)""")
def c16(t):
    students = C.student_rows(_small(t.details), _small(t.results))
    return C.attention_list(students).select("class_id", "report_id", "flagged", "weakest", "miss_count")


@query("c17_class_actions", with_(SMALL, FIRST, ITEMS, STATS, SMALL_RESULTS, TOTALS, REVIEWS) + """
, actions AS (
  SELECT class_id, 1 AS rule_ord, 'teaching' AS type, item_id, weak AS figure FROM stats WHERE weak_ratio >= 0.5
  UNION ALL SELECT class_id, 2, 'brief', item_id, miss FROM stats WHERE miss_ratio >= 0.5
  UNION ALL SELECT class_id, 3, 'rubric', item_id, hit FROM stats JOIN totals USING (class_id)
            WHERE hit = counted AND counted >= greatest(3, n_scored // 2)
  UNION ALL SELECT class_id, 4, 'review', '', needs_review_total FROM full_totals WHERE needs_review_total > 0)
SELECT a.* FROM actions a JOIN totals USING (class_id) WHERE n_scored > 0""")
def c17(t):
    stats = C.class_item_stats(_small(t.details))
    totals = C.class_totals(_small(t.results))
    figure = (F.when(F.col("rule_ord") == 1, F.col("weak")).when(F.col("rule_ord") == 2, F.col("miss"))
              .when(F.col("rule_ord") == 3, F.col("hit")).otherwise(F.col("pending")))
    return C.class_actions(stats, totals).select(
        "class_id", "rule_ord", "type", F.coalesce("item_id", F.lit("")).alias("item_id"), figure.alias("figure"))


@query("c18_build_cohort", with_(RESULTS) + """
SELECT class_id, engine, count(*) AS n, sum(coalesce(total_d, 0)) / 10.0 AS total FROM (
  SELECT * FROM results WHERE batch_id <> '5-LOW' AND engine = 'model'
  UNION ALL SELECT * FROM results WHERE batch_id = '5-LOW' AND engine = 'model')
GROUP BY 1, 2""")
def c18(t):
    stored = t.results.where("batch_id <> '5-LOW'")
    fresh = t.results.where("batch_id = '5-LOW' and engine = 'model'")
    cohort = C.build_cohort(stored, fresh)
    return cohort.groupBy("class_id", "engine").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("total", F.lit(0))).cast("double").alias("total"))


@query("c19_quality_panel", with_(SMALL, FIRST, ITEMS, STATS, SMALL_RESULTS, TOTALS, REVIEWS) + """
SELECT class_id, issue_ord, issue, CAST(value AS DOUBLE) AS value FROM (
  SELECT class_id, 1 AS issue_ord, 'system_errors' AS issue, n_incomplete AS value, n_incomplete > 0 AS on_ FROM full_totals
  UNION ALL SELECT class_id, 2, 'recall_mode', n_retrieved, n_retrieved > 0 FROM full_totals
  UNION ALL SELECT class_id, 3, 'pending_review', needs_review_total, needs_review_total > 0 FROM full_totals
  UNION ALL SELECT class_id, 4, 'small_sample', n_scored, n_scored BETWEEN 1 AND 7 FROM full_totals
  UNION ALL SELECT class_id, 5, 'low_separation', range, n_scored > 0 AND range < 15 FROM full_totals)
WHERE on_""")
def c19(t):
    stats = C.class_item_stats(_small(t.details))
    return C.quality_panel(C.class_totals(_small(t.results), stats))
