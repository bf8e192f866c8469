"""Source, sink, model-output and streaming queries. Files go to new folders below the shared folder."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classview as C
from ..operators import model_json as MJ
from ..operators.redact import clip_public_text, looks_private
from ..session import scratch
from ..sources import readers, sinks
from ..streaming import intake
from .catalog import query
from .fixtures import DETAILS, FIRST, HISTORY, RESULTS, TEXTS, with_
from .q_classview import ITEMS, REVIEWS, STATS, TOTALS
from .q_text import EMAIL


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("s1_read_reports", """
SELECT source AS class_id, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents GROUP BY source""")
def s1(t):
    """Texts written per class as .txt files and read back; only line breaks depend on the file layout."""
    path = scratch(t.spark, "texts")
    t.raw("documents").select("source", "text").write.partitionBy("source").text(path)
    files = readers.read_reports(t.spark, path)
    letters = F.length(F.replace("raw_text", F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("class_id")).agg(F.sum(letters).alias("chars"))


def _batch_lines(t):
    """One graded batch document per report: lists under three names, `v` for every other report, text numbers."""
    odd = F.col("report_id") % 2 == 1
    detail = F.struct(
        F.col("item_id").alias("id"), F.col("item_name").alias("name"), F.when(~odd, F.col("verdict")).alias("verdict"),
        F.when(odd, F.col("verdict")).alias("v"), F.col("score").cast("string").alias("s"),
        F.col("max_score").alias("max"), F.col("confidence").alias("confidence"), "needs_review", "system_error")
    # at most one entry per rubric item after the first-judgement rule
    nested = C.first_judgement(t.details).groupBy("report_id").agg(F.array_sort(F.collect_list(detail)).alias("details"))
    rows = t.results.select("report_id", "total", "total_incomplete", "coverage").join(nested, "report_id", "left")
    report = F.array(F.struct(F.col("report_id").cast("string").alias("report_id"), F.col("total").cast("string").alias("total"),
                              "total_incomplete", "coverage", "details"))
    kind = F.col("report_id") % 3
    doc = F.struct(F.lit("v2").alias("version"), F.lit("top").alias("course"),
                   F.when(kind == 0, F.struct(F.lit("from config").alias("course"))).alias("config"),
                   F.when(kind == 0, report).alias("results"), F.when(kind == 1, report).alias("reports"),
                   F.when(kind == 2, report).alias("details"))
    text = F.when(F.col("report_id") % 50 == 0, "{broken").otherwise(F.to_json(doc))
    return rows.select("report_id", text.alias("line"))


@query("s2_read_graded_batches", with_(DETAILS, FIRST, RESULTS) + """
SELECT CAST(f.report_id AS VARCHAR) AS report_id, CASE WHEN f.report_id % 3 = 0 THEN 'from config' ELSE 'top' END AS course,
       item_id, verdict, score_c / 100.0 AS score, max_c / 100.0 AS max_score, f.needs_review, system_error,
       coalesce(total_d / 10.0, -1) AS total
FROM firsts f JOIN results r USING (report_id) WHERE f.report_id % 50 <> 0""")
def s2(t):
    path = scratch(t.spark, "batches")
    _batch_lines(t).select("line").write.text(path)
    batches = readers.read_graded_batches(t.spark, path, one_per_line=True)
    rows = readers.batch_details(batches, "course")
    return _doubles(rows, "score", "max_score", "total").select(
        "report_id", F.col("class_id").alias("course"), "item_id", "verdict", "score", "max_score", "needs_review",
        "system_error", F.coalesce("total", F.lit(-1.0)).alias("total"))


@query("s2_rejected_batches", with_(DETAILS, RESULTS) + """
SELECT CASE WHEN r.report_id % 50 = 0 THEN 'unreadable' WHEN d.report_id IS NULL THEN 'no_judgements' ELSE 'taken' END AS outcome, count(*) AS documents
FROM results r LEFT JOIN (SELECT DISTINCT report_id FROM details) d USING (report_id) GROUP BY 1""")
def s2b(t):
    """Every document of the folder, by what became of it."""
    path = scratch(t.spark, "batches")
    _batch_lines(t).select("line").write.text(path)
    documents = readers.batch_documents(t.spark, path, one_per_line=True)
    return documents.groupBy(F.coalesce("reject", F.lit("taken")).alias("outcome")).agg(F.count("*").alias("documents"))


@query("s3_rejected_presets", with_(DETAILS, FIRST) + """
SELECT CASE WHEN report_id % 40 = 0 THEN 'not json' ELSE '{"report_id":"' || report_id || '"}' END AS value,
       CASE WHEN report_id % 40 = 0 THEN 'unreadable' ELSE 'no_judgements' END AS reason
FROM (SELECT DISTINCT report_id FROM firsts) WHERE report_id % 40 = 0 OR report_id % 7 = 0""")
def s3b(t):
    """Stored results that hold no judgements or are no JSON, each with its whole text."""
    report = F.col("report_id")
    whole = F.to_json(F.struct(report.cast("string").alias("report_id"), F.array(F.struct(F.lit("r1").alias("rubric_item_id"))).alias("judgements")))
    line = F.when(report % 40 == 0, "not json").when(report % 7 == 0, F.to_json(F.struct(report.cast("string").alias("report_id")))).otherwise(whole)
    path = scratch(t.spark, "presets")
    C.first_judgement(t.details).select("report_id").distinct().select(line.alias("line")).write.text(path)
    return readers.rejected_presets(t.spark, path, one_per_line=True).select("value", "reason")


@query("s3_read_preset_results", with_(DETAILS, FIRST) + """
SELECT CAST(report_id AS VARCHAR) AS report_id, CASE WHEN report_id % 2 = 0 THEN 'model' ELSE '' END AS engine,
       sum(score_c) / 100.0 AS total, count(*) AS judgements FROM firsts WHERE report_id % 40 <> 0 GROUP BY report_id""")
def s3(t):
    judged = F.struct(F.col("item_id").alias("rubric_item_id"), "verdict", "score", "confidence", "needs_review", "system_error")
    rows = C.first_judgement(t.details).groupBy("report_id").agg(
        F.sum("score").alias("total"), F.array_sort(F.collect_list(judged)).alias("judgements"))
    result = F.struct(F.col("report_id").cast("string").alias("report_id"), "total", "judgements")
    wrapped = F.to_json(F.struct(F.struct(F.lit("model").alias("engine")).alias("_meta"), result.alias("result")))
    line = F.when(F.col("report_id") % 40 == 0, "not json").when(F.col("report_id") % 2 == 0, wrapped).otherwise(F.to_json(result))
    path = scratch(t.spark, "presets")
    rows.select(line.alias("line")).write.text(path)
    out = readers.read_preset_results(t.spark, path, one_per_line=True)
    return out.select("report_id", F.coalesce("engine", F.lit("")).alias("engine"), F.col("total").cast("double").alias("total"),
                      F.size("judgements").alias("judgements"))


@query("s4_read_gold_sheet", """
SELECT CAST(doc_id AS VARCHAR) AS report_id, 'quality' AS item_id, CAST(quality AS VARCHAR) AS score,
       CASE WHEN quality = 1 THEN 'hit' ELSE 'miss' END AS verdict, CASE WHEN toxic = 1 THEN 'toxic, flagged' ELSE '' END AS note,
       1 + row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id, quality, toxic) AS row_no
FROM labels""")
def s4(t):
    """Four sheets, each sorted, written as CSV and read back in splits with the line of every row."""
    path = scratch(t.spark, "sheet")
    cells = t.raw("labels").select(
        (F.col("doc_id") % 4).alias("sheet"), "doc_id", "quality", "toxic", F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("report_id"),
        F.lit("quality ").alias("item_id"), F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit(" ")).alias("score"),
        F.when(F.col("quality") == 1, "hit").otherwise("miss").alias("verdict"), F.lit("").alias("evidence"),
        F.when(F.col("toxic") == 1, "toxic, flagged").otherwise("").alias("note"))
    dealt = cells.repartition("sheet").sortWithinPartitions("sheet", "doc_id", "quality", "toxic")
    dealt.drop("doc_id", "quality", "toxic").write.partitionBy("sheet").option("header", True).csv(path)
    return readers.read_gold_sheet(t.spark, f"{path}/*").select("report_id", "item_id", "score", "verdict", "note", "row_no")


@query("s5_read_seal", """
SELECT c_custkey AS dataset_id, u.key, CASE u.key WHEN 'scorer' THEN c_name ELSE c_mktsegment END AS value
FROM customer CROSS JOIN (VALUES ('scorer'), ('role')) u(key)""")
def s5(t):
    sheet = F.concat(F.lit("seal record,\n,\nscorer, "), "c_name", F.lit("\n,ignored\nrole,"), "c_mktsegment", F.lit("\n"))
    return readers.parse_seal(t.raw("customer").select(F.col("c_custkey").alias("dataset_id"), sheet.alias("value")))


@query("s6_write_batch", with_(DETAILS) + """
SELECT batch_id, n, score, batch_id = 'full' AS is_latest FROM (
  SELECT CASE WHEN report_id % 10 = 0 THEN 'part' ELSE 'full' END AS batch_id, count(*) AS n, sum(score_c) / 100.0 AS score
  FROM details GROUP BY 1)""")
def s6(t):
    path = scratch(t.spark, "store")
    rows = t.details.select("report_id", "item_id", "score")
    sinks.write_batch(rows.where("report_id % 10 <> 0"), path, "full", "2024-01-01T00:00:00")
    sinks.write_batch(rows.where("report_id % 10 = 0"), path, "part", "2024-01-02T00:00:00", partial=True)
    latest = sinks.latest_batch(t.spark.read.parquet(f"{path}/pointer")).select(
        "batch_id", F.lit(True).alias("is_latest"))
    stored = sinks.read_batch(t.spark, path).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("score").cast("double").alias("score"))
    return stored.join(latest, "batch_id", "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


def _pointer(t):
    return t.raw("events").select(F.col("event_id").alias("batch_id"), F.col("ts").alias("created_at"),
                                  (F.col("event_type") != "error").alias("promoted"))


@query("s7_latest_batch", """
SELECT arg_max(event_id, (ts, event_id)) AS batch_id FROM events WHERE event_type <> 'error'""")
def s7(t):
    return sinks.latest_batch(_pointer(t)).select("batch_id")


@query("s7_list_batches", """
SELECT user_id AS batch_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY user_id""")
def s7b(t):
    runs = t.raw("events").select(F.col("user_id").alias("batch_id"), F.col("ts").alias("created_at"))
    return sinks.list_batches(runs).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


CELL = "CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || text"


def _cells(t):
    lead = F.array(*[F.lit(c) for c in ("=", "+", "-", "@", "")])[F.pmod("report_id", F.lit(5)).cast("int")]
    return t.reports.select("report_id", F.concat(lead, "raw_text").alias("cell"))


@query("s8_csv_safe", f"""
SELECT doc_id AS report_id, CASE WHEN left({CELL}, 1) IN ('=', '+', '-', '@') THEN '''' || {CELL} ELSE {CELL} END AS cell FROM documents""")
def s8(t):
    return sinks.csv_safe(_cells(t))


@query("s8_write_csv", """
SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 4 = 0 THEN '''=' ELSE '' END || o_orderpriority || ', "quoted"' AS note FROM orders""")
def s8b(t):
    path = scratch(t.spark, "csv")
    note = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "=").otherwise(""), "o_orderpriority", F.lit(', "quoted"'))
    sinks.write_csv(t.raw("orders").select(F.col("o_orderkey").alias("report_id"), note.alias("note")), path)
    return t.spark.read.schema("report_id bigint, note string").option("header", True).option("escape", '"').csv(path)


@query("s9_export_class_json", with_(DETAILS, FIRST, ITEMS, STATS, RESULTS, TOTALS, REVIEWS) + """
, actions AS (
  SELECT class_id, count(*) FILTER (weak_ratio >= 0.5) + count(*) FILTER (miss_ratio >= 0.5)
           + count(*) FILTER (hit = counted AND counted >= greatest(3, n_scored // 2)) + any_value(CAST(needs_review_total > 0 AS INTEGER)) AS n
  FROM stats JOIN full_totals USING (class_id) WHERE n_scored > 0 GROUP BY class_id)
SELECT class_id, 'action' AS part, CAST(n AS BIGINT) AS lines FROM actions WHERE n > 0
UNION ALL SELECT class_id, 'student' AS part, count(*) AS lines FROM results GROUP BY class_id
UNION ALL SELECT class_id, 'item', count(DISTINCT item_id) FROM details GROUP BY class_id
UNION ALL SELECT DISTINCT class_id, 'aggregate', 1 FROM results""")
def s9(t):
    stats = C.class_item_stats(t.details)
    totals = C.class_totals(t.results, stats)
    lines = sinks.export_class_json(totals, stats, C.class_actions(stats, totals), C.student_rows(t.details, t.results))
    path = scratch(t.spark, "class-json")
    sinks.write_class_json(lines, path)
    back = t.spark.read.schema("class_id string, part string").json(path)
    return back.groupBy("class_id", "part").agg(F.count("*").alias("lines"))


@query("s10_admit_files", r"""
WITH files AS (
  SELECT doc_id, 'up/' || doc_id || ['.txt', '.pdf', '.docx', '.exe', '.MD', '.pdf'][doc_id % 6 + 1] AS path,
         doc_id % 6 AS kind, doc_id % 5 = 0 AS nul FROM documents)
SELECT path, CASE WHEN kind = 3 THEN 'extension' WHEN kind IN (0, 4) AND nul THEN 'content' WHEN kind = 5 THEN 'content' ELSE '' END AS reason
FROM files""")
def s10(t):
    kind = F.pmod("report_id", F.lit(6)).cast("int")
    ext = X.words((".txt", ".pdf", ".docx", ".exe", ".MD", ".pdf"))[kind]
    head = X.words(("", "%PDF-1.7 ", "PK ", "MZ ", "", "%pdf "))[kind]
    nul = F.when(kind.isin(0, 4) & (F.col("report_id") % 5 == 0), F.char(F.lit(0))).otherwise("")
    files = t.reports.select(F.concat(F.lit("up/"), F.col("report_id").cast("string"), ext).alias("path"),
                             F.encode(F.concat(head, nul, "raw_text"), "UTF-8").alias("content"))
    return readers.admit_files(files).select("path", "reason")


@query("s11_history_bundle", with_(HISTORY) + """
SELECT sid, name, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at, CAST(entry_id AS VARCHAR) AS report_id, CAST(total AS DOUBLE) AS total,
       unnest(['item ' || entry_id % 7, 'said "twice"']) AS item, CAST(total / 2 AS DOUBLE) AS score, 'ok' AS status,
       'issue ' || entry_id || '|so' AS issues
FROM history WHERE total <> 13""")
def s11(t):
    path = scratch(t.spark, "bundle")
    # a total of 13 stands for an entry whose result cannot be read back
    e = F.col("entry_id").cast("string")
    issues = F.array(*[F.struct(p.alias("problem"), F.lit("l").alias("location"), F.lit("i").alias("impact"), F.lit("d").alias("direction"))
                       for p in (F.concat(F.lit("issue "), e), F.lit("so"))])
    items = F.array(*[F.struct(n.alias("name"), (F.col("total") / 2).alias("score"), F.lit("ok").alias("status"), issues.alias("issues"))
                      for n in (F.concat(F.lit("item "), (F.col("entry_id") % 7).cast("string")), F.lit('said "twice"'))])
    full = t.history.withColumns({"report_id": F.col("entry_id"), "items": items})
    sinks.write_bundle(full.withColumn("total", F.when(F.col("total") != 13, F.col("total"))), path)
    back = readers.import_bundle(t.spark, path).withColumn("i", F.explode("items"))
    return back.select("sid", "name", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), "report_id", "total",
                       F.col("i.name").alias("item"), "i.score", "i.status",
                       F.array_join(F.transform("i.issues", lambda x: x["problem"]), "|").alias("issues"))


@query("s12_write_public_cases", with_(TEXTS) + rf"""
SELECT CAST(report_id AS VARCHAR) AS report_id, report_id = 1 AS is_default FROM texts WHERE NOT regexp_matches(full_text, '{EMAIL}')""")
def s12(t):
    from ..constants import PUBLIC_CHECKERS
    private = F.lit(False)
    for label, pattern in PUBLIC_CHECKERS:
        private = private | looks_private(F.col("full_text"), label, pattern)
    quotes = t.attempts.select("report_id", F.explode("evidence").alias("quote"))
    cases = clip_public_text(t.texts.where(~private), quotes).withColumn("report_id", F.col("report_id").cast("string"))
    path = scratch(t.spark, "public")
    sinks.write_public_cases(cases, path, default_id="1")
    return t.spark.read.schema("report_id string, is_default boolean").json(f"{path}/manifest")


# ---- model output strings ----------------------------------------------------------
@query("j1_parse_model_json", with_(TEXTS, """cut AS (
  SELECT report_id, regexp_replace(full_text, '["\\\\]', '', 'g') AS words FROM texts)""") + r"""
SELECT report_id, CASE WHEN report_id % 6 = 2 THEN 'he wrote "results" and ' || words
                       WHEN report_id % 6 = 4 THEN words || chr(10) || 'next line'
                       WHEN report_id % 6 = 3 THEN rtrim(words) ELSE words END AS reason,
       CASE WHEN report_id % 6 = 3 THEN 0 ELSE 7 END AS score, report_id % 6 IN (2, 3, 4) AS repaired
FROM cut""")
def j1(t):
    """Valid, fenced, bare-quoted, cut-off, raw-newline and chatty answers derived from the texts."""
    words = F.regexp_replace("full_text", r'["\\]', "")
    kind = F.pmod("report_id", F.lit(6))
    ok = F.concat(F.lit('{"score":7,"reason":"'), "words", F.lit('"}'))
    raw = (F.when(kind == 1, F.concat(F.lit("```json\n"), ok, F.lit("\n```")))
           .when(kind == 2, F.concat(F.lit('{"score":7,"reason":"he wrote "results" and '), "words", F.lit('"}')))
           .when(kind == 3, F.concat(F.lit('{"reason":"'), "words"))
           .when(kind == 4, F.concat(F.lit('{"score":7,"reason":"'), "words", F.lit('\nnext line"}')))
           .when(kind == 5, F.concat(F.lit("Here it is: "), ok, F.lit(" Done."))).otherwise(ok))
    answers = t.texts.select("report_id", words.alias("words")).select("report_id", raw.alias("raw"))
    out = MJ.parse_model_json(answers, "score int, reason string")
    return out.select("report_id", F.coalesce("parsed.reason", F.lit("")).alias("reason"),
                      F.coalesce("parsed.score", F.lit(0)).alias("score"), "repaired")


# ---- streaming ---------------------------------------------------------------------
RECORDS = """records AS (
  SELECT event_id, ts, 'c' || (user_id % 5) AS class_id, event_type AS item_id, least(100, CAST(floor(value) AS BIGINT)) AS score,
         ['hit', 'partial', 'miss'][event_id % 3 + 1] AS verdict, event_id % 7 = 0 AS needs_review, event_id % 11 = 0 AS failed
  FROM events),
stats AS (
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, class_id, item_id, count(*) AS counted,
         count(*) FILTER (verdict = 'hit') AS hit, count(*) FILTER (verdict = 'partial') AS partial,
         count(*) FILTER (verdict = 'miss') AS miss, CAST(sum(score) AS BIGINT) AS score_sum, count(*) FILTER (needs_review) AS needs_review,
         date_trunc('day', min(ts)) + INTERVAL 1 DAY AS closes
  FROM records WHERE NOT failed GROUP BY ALL)"""
RECORD_COLUMNS = "day, class_id, item_id, counted, hit, partial, miss, score_sum, needs_review"


def _records(events):
    n = F.col("event_id")
    once = events.select(
        n.alias("record_id"), F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("class_id"), F.col("event_type").alias("item_id"),
        F.least(F.lit(100), F.floor("value")).cast("bigint").alias("score"),
        X.words(("hit", "partial", "miss"))[(n % 3).cast("int")].alias("verdict"), (n % 7 == 0).alias("needs_review"),
        F.when(n % 11 == 0, "call failed").otherwise("").alias("system_error"))
    # every fourth record is delivered twice
    return once.withColumn("_copy", F.explode(F.when(F.col("record_id") % 4 == 0, F.array(F.lit(1), F.lit(2)))
                                              .otherwise(F.array(F.lit(1))))).drop("_copy")


def _by_day(df):
    return df.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).selectExpr(*RECORD_COLUMNS.split(", "))


@query("w1_class_stats_batch", with_(RECORDS) + f"SELECT {RECORD_COLUMNS} FROM stats")
def w1(t):
    return _by_day(intake.stream_class_stats(_records(t.raw("events"))))


def _stream(t):
    source = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    path = scratch(t.spark, "stream")
    return _records(source), path


@query("w1_closed_windows", with_(RECORDS) + f"""
SELECT {RECORD_COLUMNS} FROM stats WHERE closes <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def w1b(t):
    """The same statistics from a stream of the events file: windows the watermark has closed."""
    records, path = _stream(t)
    intake.run_available(intake.stream_class_stats(records), f"{path}/out", f"{path}/state")
    return _by_day(t.spark.read.parquet(f"{path}/out"))


@query("w1_class_stats_stream", with_(RECORDS) + f"SELECT {RECORD_COLUMNS} FROM stats")
def w1c(t):
    """The statistics of the whole stream, its last windows included: the same rows as from the batch."""
    records, path = _stream(t)
    intake.run_intake(records, path)
    return _by_day(intake.intake_stats(t.spark, path))


@query("w1_rejected_records", "SELECT event_id AS record_id, 'repeated' AS status FROM events WHERE event_id % 4 = 0")
def w1d(t):
    """Every record of the stream that did not count: here the second copies."""
    records, path = _stream(t)
    intake.run_intake(records, path)
    return intake.rejected_records(t.spark, path).select("record_id", "status")


@query("w2_daily_quota", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS session_id, count(*) AS used,
       greatest(3 - count(*), 0) AS remaining, count(*) >= 3 AS exhausted
FROM events GROUP BY 1, 2""")
def w2(t):
    calls = t.raw("events").select(
        F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("session_id"))
    return intake.daily_quota(calls, 3).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
