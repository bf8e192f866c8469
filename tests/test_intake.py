"""The intake of a stream in deliveries: every record counts once or is listed, whatever the batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeframe.streaming import intake

SCHEMA = "record_id long, event_time timestamp, class_id string, item_id string, score long, verdict string, needs_review boolean, system_error string"
DAY = dt.datetime(2024, 5, 1)


def record(i, hours, score=1, error=""):
    at = None if hours is None else DAY + dt.timedelta(hours=hours)
    return (i, at, f"c{(i or 0) % 2}", "i1", score, ("hit", "partial", "miss")[(i or 0) % 3], False, error)


@pytest.fixture
def deliver(spark, tmp_path):
    """Write each delivery as one file, run the intake after each, return the folder."""
    def run(deliveries, together=False, **options):
        source, folder = str(tmp_path / "in"), str(tmp_path / "out")
        for k, rows in enumerate(deliveries):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            if not together or k == len(deliveries) - 1:
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
                intake.run_intake(stream, folder, **options)
        return folder

    return run


def stats(spark, folder):
    return sorted((r.window_start.day, r.class_id, r.counted, r.score_sum) for r in intake.intake_stats(spark, folder).collect())


def rejected(spark, folder):
    return sorted((r.record_id, r.status, r.score) for r in intake.rejected_records(spark, folder).collect())


@pytest.mark.parametrize("together", [False, True])
def test_last_windows_late_and_repeated_records(spark, deliver, together):
    first = [record(1, 1), record(2, 2), record(2, 2), record(3, 20)]
    second = [record(3, 20), record(4, 5, 50), record(5, 30), record(6, 19.5), record(1, 1)]
    third = [record(7, 70), record(5, 30, 9), record(8, 29.5), record(9, 28, 60)]
    folder = deliver([first, second, third], together)
    # the watermark stands at 19 hours in the second delivery and at 29 hours in the third
    assert rejected(spark, folder) == [(1, "late", 1), (2, "repeated", 1), (3, "repeated", 1), (4, "late", 50), (5, "repeated", 9), (9, "late", 60)]
    assert stats(spark, folder) == [(1, "c0", 2, 2), (1, "c1", 2, 2), (2, "c0", 1, 1), (2, "c1", 1, 1), (3, "c1", 1, 1)]


def test_stream_equals_batch_when_nothing_is_late(spark, deliver):
    rows = [record(i, i / 40, i % 5, "" if i % 11 else "failed") for i in range(3000)]
    folder = deliver([rows[:1000] + rows[:5], rows[1000:1003], rows[1003:] + rows[2990:]], lateness="30 days")
    batch = intake.stream_class_stats(spark.createDataFrame(rows, SCHEMA))
    columns = sorted(batch.columns)
    assert sorted(map(repr, intake.intake_stats(spark, folder).select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))
    assert len(rejected(spark, folder)) == 15


def test_null_times_and_keys_are_taken_and_empty_deliveries_do_nothing(spark, deliver):
    folder = deliver([[record(None, 1), record(None, 1), record(3, None)], [], [record(3, None), record(4, 2)]])
    assert [r[:2] for r in rejected(spark, folder)] == [(3, "repeated")]
    assert sum(r[2] for r in stats(spark, folder)) == 3


def test_a_batch_that_runs_again_overwrites_itself(spark, deliver):
    folder = deliver([[record(1, 1), record(1, 1)]])
    before = stats(spark, folder)
    again = spark.read.parquet(f"{folder}/taken/batch=0")
    intake._stats(again.where(F.col("status") == "new"), "1 day").write.mode("overwrite").parquet(f"{folder}/sums/batch=0")
    assert stats(spark, folder) == before == [(1, "c1", 1, 1)]
