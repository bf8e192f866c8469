"""Running ids over ranges, and the anonymised corpus built on them."""

import random

import pytest
from pyspark.sql import functions as F

from gradeframe.functions.numbering import running_ids, scan_groups
from gradeframe.operators import history as H
from gradeframe.operators import redact as R


@pytest.fixture
def many_ranges(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "13")
    spark.conf.set(names[1], "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["text", "sparse", "block", "date"])
def test_ids_of_any_type_are_numbered_in_order(spark, many_ranges, kind):
    rng = random.Random(kind)
    keys = {"text": [f"s/{rng.randrange(10 ** 6)}-é{i}" for i in range(700)], "sparse": rng.sample(range(-10 ** 17, 10 ** 17), 700),
            "block": list(range(5 * 10 ** 9, 5 * 10 ** 9 + 1500)), "date": [f"2024-01-{1 + i % 28:02d} {i:06d}" for i in range(500)]}[kind]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string" if kind in ("text", "date") else "k long").repartition(5)
    got = {r.k: r.running_id for r in running_ids(df, "k").collect()}
    order = sorted(keys, key=lambda k: k.encode() if isinstance(k, str) else k)
    assert got == {k: i for i, k in enumerate(order, 1)}


def test_ties_nulls_several_columns_and_nothing(spark, many_ranges):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 1), ("a", 2), ("b", 0)] * 3, "k string, n int")
    got = sorted((r.i, r.k, r.n) for r in running_ids(df, "k", F.desc("n"), name="i").collect())
    assert [g[0] for g in got] == list(range(1, 16))
    assert [g[1:] for g in got] == [(None, 1)] * 3 + [("a", 2)] * 6 + [("a", 1)] * 3 + [("b", 0)] * 3
    assert running_ids(df.limit(0), "k").count() == 0


def test_no_task_sorts_everything(spark, many_ranges):
    df = spark.range(20_000).select(F.concat(F.lit("same prefix "), F.format_string("%09d", "id")).alias("k"))
    sizes = running_ids(df, "k").groupBy(F.spark_partition_id()).count().collect()
    plan = running_ids(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and len(sizes) > 1


def test_record_of_an_anonymised_corpus(spark):
    long = "A report about pumps and valves, with all the readings of one long afternoon in the laboratory of the school. "
    rows = [("b/two.txt", "x/b/two.txt", long + "mail a.b@c.org"), ("a/one.txt", "x/a/one.txt", long + "学号: X"), ("c", None, "  too short  "), ("d", "y/d.md", None),
            ("z/10.txt", "x/z/10.txt", long + "姓名: Lee")]
    df = spark.createDataFrame(rows, "report_id string, path string, raw_text string")
    got = {r.report_id: r for r in R.anonymize_corpus(df).collect()}
    assert {k: (r.anonymous_id, r.original) for k, r in got.items()} == {
        "a/one.txt": ("S01", "one.txt"), "b/two.txt": ("S02", "two.txt"), "z/10.txt": ("S03", "10.txt")}
    assert got["a/one.txt"].residual == {"疑似真姓名行": 1} and got["b/two.txt"].residual == {} and got["b/two.txt"].hits == {"邮箱": 1}
    assert got["b/two.txt"].chars == len(got["b/two.txt"].redacted)
    rejected = sorted(tuple(r) for r in R.rejected_reports(df).collect())
    assert rejected == [("c", "c", 13, "too_short"), ("d", "d.md", 0, "too_short")]
    named = spark.createDataFrame([(7, "seven", "short")], "report_id long, name string, raw_text string")
    assert R.rejected_reports(named).first().original == "seven"


def test_groups_are_scanned_across_ranges(spark, many_ranges):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(9)) for i in range(3000)] + [(f"k{i % 40}", i, i) for i in range(300)] + [(None, i, i) for i in range(5)] + [("one", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(5)
    got = sorted(((r.k or "", r.n, r.v, r.i, r.before) for r in scan_groups(df, ["k"], ["n"], "i", {"before": "v"}).collect()))
    want, last = [], {}
    for k, n, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        i, before = last.get(k, (0, None))
        want.append((k or "", n, v, i + 1, before))
        last[k] = (i + 1, v)
    assert got == want
    assert scan_groups(df.limit(0), ["k"], ["n"], "i", {"before": "v"}).count() == 0


def test_one_instant_of_one_archive_is_many_tasks(spark, many_ranges):
    """A bulk import at one instant is numbered, and its trend taken, without a task that holds it all."""
    n = 40_000
    entries = spark.range(n, numPartitions=6).select(
        F.lit("aaaaaaaa").alias("sid"), F.lit("r").alias("name"), F.timestamp_seconds(F.lit(0)).alias("saved_at"),
        (n - F.col("id")).alias("entry_id"), (F.col("id") % 101).alias("total"))
    stored = H.append_history(entries)
    assert stored.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq"), F.count_if(F.col("seq") != F.col("entry_id"))).first()[:] == (1, n, n, 0)
    steps = H.trend(stored)
    sizes = [r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 2
    first = steps.where("seq = 1").first()
    assert first.step is None
    wrong = steps.where("seq > 1").where("total - step <> pmod(total + 1, 101)")
    assert steps.count() == n and wrong.count() == 0 and steps.where("step IS NULL").count() == 1
