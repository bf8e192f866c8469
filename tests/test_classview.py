"""Hand-computed class cases and metrics."""
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import classview as C
from gradeframe.operators import metrics as M
from gradeframe.sources import sinks

MAX = {"r1": 15, "r2": 20, "r3": 25, "r4": 20, "r5": 20}
DETAIL = ("class_id string, report_id string, pos int, item_id string, item_name string, verdict string, score decimal(9,2), "
          "max_score decimal(9,2), needs_review boolean, system_error string")
RESULT = "class_id string, report_id string, name string, total decimal(9,2), total_incomplete boolean, coverage string"


def details(spark, rows):
    """rows: (report, item, verdict, score[, system_error[, review]])"""
    return spark.createDataFrame([
        ("c", r[0], i, r[1], r[1].upper(), r[2], D(r[3]), D(MAX[r[1]]), len(r) > 5 and r[5], r[4] if len(r) > 4 else "")
        for i, r in enumerate(rows)], DETAIL)


def results(spark, totals, **more):
    return spark.createDataFrame([("c", k, k, None if t is None else D(t), more.get(k, False), "full") for k, t in totals.items()], RESULT)


def test_item_counts_and_ratios(spark):
    rows = [("a", "r5", "partial", 8), ("b", "r5", "miss", 0), ("c", "r5", "miss", 0), ("d", "r5", "miss", 0), ("a", "r1", "hit", 15)]
    got = {r.item_id: r for r in C.class_item_stats(details(spark, rows)).collect()}
    r5 = got["r5"]
    assert (r5.counted, r5.hit, r5.partial, r5.miss, r5.weak_ratio, r5.miss_ratio, r5.avg_score) == (4, 0, 1, 3, 1.0, 0.75, 2.0)
    assert got["r5"].item_ord == 1 and got["r1"].item_ord == 2
    kinds = {(r.type, r.item_id) for r in C.actions_teaching(C.class_item_stats(details(spark, rows))).collect()}
    assert kinds == {("teaching", "r5")}


def test_system_errors_are_nobodys_fault(spark):
    rows = [("a", "r1", "hit", 15), ("b", "r1", "miss", 0), ("c", "r1", "miss", 0, "call failed")]
    stats = C.class_item_stats(details(spark, rows)).first()
    assert (stats.counted, stats.miss) == (2, 1)
    totals = C.class_totals(results(spark, {"a": 80, "b": 40, "c": 0}, c=True)).first()
    assert (totals.n_reports, totals.n_scored, totals.n_incomplete, totals.mean) == (3, 2, 1, 60.0)


def test_first_judgement_wins(spark):
    rows = [("a", "r1", "hit", 15), ("a", "r1", "miss", 0)]
    assert C.class_item_stats(details(spark, rows)).first().hit == 1


def test_totals_and_histogram(spark):
    res = results(spark, {"a": 100, "b": 90, "c": 82, "d": 53})
    t = C.class_totals(res).first()
    assert (t.range, t.pass_rate, t.excellent_rate) == (47.0, 75.0, 50.0)
    bins = {r.label: r["count"] for r in C.score_histogram(res).collect()}
    assert bins == {"<60": 1, "60-70": 0, "70-80": 0, "80-90": 1, "90-100": 2}


def test_students_lists(spark):
    rows = [("a", "r1", "partial", 6), ("a", "r3", "miss", 0), ("b", "r1", "hit", 15), ("c", "r1", "partial", 9, "", True)]
    students = C.student_rows(details(spark, rows), results(spark, {"a": 30, "b": 95, "c": None}))
    got = {r.report_id: r for r in students.collect()}
    assert (got["a"].weakest, got["a"].weakest_gap, got["a"].miss_count) == ("R3", 25.0, 1)
    assert got["c"].total is None and got["b"].weakest == ""
    assert [r.report_id for r in C.order_students(students).collect()] == ["a", "b", "c"]
    assert [r.report_id for r in C.focus_students(students).collect()] == ["a"]
    assert [r.report_id for r in C.exemplars(students).collect()] == ["b"]
    assert {r.report_id: r.flagged for r in C.attention_list(students).collect()} == {"a": True, "c": True}
    quiet = C.student_rows(details(spark, rows[2:3]), results(spark, {"b": 95, "x": 90}))
    assert {r.report_id: r.flagged for r in C.attention_list(quiet).collect()} == {"b": False, "x": False}


def test_notes_and_cohort(spark):
    note = C.class_notes(C.class_totals(results(spark, {"a": 1}, a=True))).first()
    assert not note.ok and note.reason == "no_scored_reports"
    frame = results(spark, {"a": 1}).selectExpr("*", "'rule' as engine")
    assert C.build_cohort(frame, frame, "rule").count() == 1
    assert C.mixed_engines(frame.unionByName(frame.selectExpr("* except (engine)", "'model' as engine"))).count() == 1
    with pytest.raises(ValueError):
        C.build_cohort(frame, frame, "rule", existing_engine="model")


def test_pearson_guards(spark):
    rows = [("b", str(i), D(50), D(i)) for i in range(4)] + [("s", "1", D(1), D(2)), ("s", "2", D(2), D(4))]
    rows += [("l", str(i), D(i), D(2 * i)) for i in range(4)]
    df = spark.createDataFrame(rows, "batch_id string, report_id string, gold decimal(9,2), ai decimal(9,2)")
    got = {r.batch_id: r.pearson for r in M.pearson(df).collect()}
    assert got["b"] is None and got["s"] is None and got["l"] == pytest.approx(1.0)


def test_gold_import_is_all_or_nothing(spark):
    rub = spark.createDataFrame([("r1", 15.0), ("r2", 20.0)], "item_id string, max_score double")
    rows = [("full", "r1", "15", "hit"), ("full", "r2", " 3 ", "miss"), ("none", "r1", "", ""), ("none", "r2", None, None),
            ("half", "r1", "5", "partial"), ("half", "r2", "", ""), ("bad", "r1", "16", "hit"), ("bad", "r2", "x", "hit")]
    sheet = spark.createDataFrame([(i, *r, "", "") for i, r in enumerate(rows)],
                                  "row_no int, report_id string, item_id string, score string, verdict string, evidence string, note string")
    got = M.import_gold(sheet, rub)
    assert {r.report_id for r in got.items.collect()} == {"full"} and [r.report_id for r in got.excluded.collect()] == ["none"]
    assert {(r.report_id, r.problem) for r in got.problems.collect()} == {
        ("half", "partly_filled"), ("bad", "out_of_range"), ("bad", "not_a_number")}


def test_fingerprint_follows_scores_only(spark):
    def fp(rows):
        return M.score_fingerprint(spark.createDataFrame(rows, "report_id string, item_id string, score decimal(9,2)")).first().fingerprint
    base = [("a", "r1", D(1)), ("a", "r2", D(2)), ("b", "r1", D(3))]
    assert fp(base) == fp(base[::-1]) != fp(base[:2] + [("b", "r1", D(4))])


def test_items_in_the_order_of_the_batch(spark):
    """Reports out of id order, items renamed later, text ids with and without a place."""
    rows = [("z", 0, 5, "i2", "Second"), ("z", 0, 9, "i1", "First"), ("a", 1, 0, "i3", "Third"), ("a", 1, 1, "i2", "Renamed"), ("m", 2, 0, "i0", None)]
    schema = "report_id string, report_ord int, pos long, item_id string, item_name string"
    df = spark.createDataFrame(rows, schema).selectExpr("'c' AS class_id", "*", "'hit' AS verdict", "CAST(3 AS DECIMAL(9,2)) AS score",
                                                        "CAST(report_ord + 4 AS DECIMAL(9,2)) AS max_score", "false AS needs_review", "'' AS system_error").repartition(4)
    want = [("i2", "Second"), ("i1", "First"), ("i3", "Third"), ("i0", "i0")]
    assert [(r.item_id, r.item_name) for r in C.class_items(df).orderBy("item_ord").collect()] == want
    stats = C.class_item_stats(df).orderBy("item_ord").collect()
    assert [(r.item_id, r.item_name) for r in stats] == want and stats[0].counted == 2 and float(stats[0].max_score) == 4
    by_id = C.class_items(df.drop("report_ord")).orderBy("item_ord").collect()
    assert [r.item_id for r in by_id] == ["i3", "i2", "i0", "i1"] and by_id[1].item_name == "Renamed"
    for out in (C.class_items(df), C.class_item_stats(df)):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_actions_with_and_without_given_review_counts(spark):
    rows = [("a", "r1", "hit", 15, "", True), ("b", "r1", "hit", 15), ("c", "r1", "hit", 15), ("a", "r2", "miss", 0), ("b", "r2", "miss", 0), ("c", "r2", "hit", 20)]
    stats, res = C.class_item_stats(details(spark, rows)), results(spark, {"a": 40, "b": 50, "c": 90})
    want = {("teaching", "r2", None), ("brief", "r2", None), ("rubric", "r1", None), ("review", None, 1)}
    for totals in (C.class_totals(res), C.class_totals(res, stats)):
        got = C.class_actions(stats, totals).collect()
        assert {(r.type, r.item_id, r.pending) for r in got} == want and len(got) == 4
    none = C.class_actions(stats, C.class_totals(results(spark, {"a": 40}, a=True)))
    assert none.count() == 0
    # a class without judged items still has its pending reviews listed once
    alone = C.class_totals(res).withColumn("needs_review_total", F.lit(7))
    assert [(r.type, r.pending) for r in C.class_actions(stats.limit(0), alone).collect()] == [("review", 7)]


def test_class_export_writes_few_files_per_class(spark, tmp_path):
    many = spark.range(4000, numPartitions=16).select(
        F.format_string("c%d", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20)).alias("class_id"), F.lit("line").alias("line"))
    lines = many.unionByName(many).unionByName(many)
    sinks.write_class_json(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    files = back.select("class_id", F.input_file_name().alias("f")).distinct().groupBy("class_id").count().collect()
    assert back.count() == 12000 and len(files) == 20 and max(r["count"] for r in files) <= 2


def test_matrix_has_the_length_of_reports(spark):
    judged = details(spark, [("a", "r1", "hit", 15), ("b", "r1", "miss", 0)])
    res = results(spark, {"a": 15, "b": 0})
    got = {r.report_id: (r.chars, r.r1) for r in M.batch_matrix(judged, ["r1"], res.withColumn("chars", F.lit(123))).collect()}
    assert got == {"a": (123, 15), "b": (123, 0)}
    assert {r.chars for r in M.batch_matrix(judged, ["r1"], res).collect()} == {None}
