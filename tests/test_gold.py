"""Score sheets with exact line numbers, import of gold scores, and fingerprints that can be recomputed by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import metrics as M
from gradeframe.sources import readers


@pytest.mark.parametrize("split", ["60", "1000", "100000000"])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    wanted = []
    for name, n in (("b.txt", 97), ("a.txt", 40), ("one.txt", 1)):
        lines = [f"{name} line {i} " + "é" * (i % 17) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if n % 2 else ""), encoding="utf-8")
        wanted += [(name, i, line) for i, line in enumerate(lines, 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = readers.numbered_lines(spark, str(tmp_path))
        assert split != "60" or df.rdd.getNumPartitions() > 0
        assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect()) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_last_row_of_the_sheet_wins_in_any_split(spark, tmp_path):
    head = "report_id,item_id,score,verdict,evidence,note\n"
    rows = [f"r{i % 5},i{i % 2},{i % 7},hit,,line {i}" for i in range(200)]
    (tmp_path / "sheet.csv").write_text(head + "\n".join(rows) + "\n")
    rubric = spark.createDataFrame([("i0", 10.0), ("i1", 10.0)], "item_id string, max_score double")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for split in ("90", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = M.import_gold(readers.read_gold_sheet(spark, str(tmp_path)), rubric)
        found.append(sorted((r.report_id, r.item_id, r.note) for r in got.items.collect()))
        assert got.problems.count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == sorted((f"r{i % 5}", f"i{i % 2}", f"line {i}") for i in range(190, 200))


def test_totals_and_refusal(spark):
    rubric = spark.createDataFrame([("x", "i1", 10.0), ("x", "i2", 5.0)], "rubric_id string, item_id string, max_score double")
    schema = "row_no long, report_id string, item_id string, score string, verdict string, evidence string, note string"
    rows = [(1, "a", "i1", "7.25", "hit", "", ""), (2, "a", "i2", "1.5", "partial", "", ""), (3, "b", "i1", "", "", "", ""), (4, "b", "i2", "", "", "", "")]
    got = M.import_gold(spark.createDataFrame(rows, schema), rubric)
    assert [(r.report_id, float(r.total)) for r in got.totals.collect()] == [("a", 8.8)]
    assert [r.report_id for r in got.excluded.collect()] == ["b"] and got.problems.count() == 0
    refused = M.import_gold(spark.createDataFrame(rows[2:], schema), rubric)
    assert [tuple(r) for r in refused.problems.collect()] == [("", "", "no_complete_report")]
    assert [r.problem for r in M.import_gold(spark.createDataFrame([], schema), rubric).problems.collect()] == ["no_complete_report"]


def published(gold):
    """The value as published, for {report: (total, {item: score})}."""
    parts = []
    for rid in sorted(gold):
        total, items = gold[rid]
        parts.append(f"{rid}:{total}")
        parts += [f"{rid}/{i}={items[i]}" for i in sorted(items)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def test_published_fingerprint(spark):
    gold = {f"S{i:02d}": (None, {"r2": i / 2, "r1": float(i), "r10": 0.25}) for i in range(60)}
    rows = [(r, i, s) for r, (_, items) in gold.items() for i, s in items.items()]
    items = spark.createDataFrame(rows, "report_id string, item_id string, score double").repartition(7)
    totals = spark.createDataFrame([(r, 50.5) for r in gold], "report_id string, total double")
    got = M.published_fingerprint(items, totals).collect()
    assert [(r.dataset_id, r.reports, r.fingerprint) for r in got] == [("", 60, published({r: (50.5, v) for r, (_, v) in gold.items()}))]
    summed = M.published_fingerprint(items.where("item_id <> 'r10'")).first()
    assert summed.fingerprint == published({r: (round(sum(v for k, v in i.items() if k != "r10"), 1), {k: v for k, v in i.items() if k != "r10"})
                                            for r, (_, i) in gold.items()})
    assert M.published_fingerprint(items.limit(0)).count() == 0


def test_tree_fingerprint_shows_scores_and_nothing_else(spark):
    rows = [(f"r{i}", f"i{k}", float(i * k % 11)) for i in range(3000) for k in range(3)]
    make = lambda rs: spark.createDataFrame(rs, "report_id string, item_id string, score double")
    base = M.score_fingerprint(make(rows)).first()
    assert base.reports == 3000
    assert M.score_fingerprint(make(rows[::-1]).repartition(11)).first().fingerprint == base.fingerprint
    changed = [(r, i, s + 0.5 if (r, i) == ("r17", "i2") else s) for r, i, s in rows]
    assert M.score_fingerprint(make(changed)).first().fingerprint != base.fingerprint
    totals = make(rows).groupBy("report_id").agg(F.sum("score").alias("total"))
    assert M.score_fingerprint(make(rows), totals).first().fingerprint == base.fingerprint
    assert M.score_fingerprint(make(rows), totals.withColumn("total", F.col("total") + F.when(F.col("report_id") == "r5", 1).otherwise(0))
                               ).first().fingerprint != base.fingerprint
    two = make(rows).withColumn("dataset_id", F.when(F.col("report_id") < "r2", "a").otherwise("b"))
    assert sorted((r.dataset_id, r.reports) for r in M.score_fingerprint(two).collect()) == [("a", 1112), ("b", 1888)]
