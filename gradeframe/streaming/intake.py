"""Continuous intake: class statistics over a stream of graded records, and the daily shared quota.

The transformations are plain DataFrame code; the same function serves a batch table and a stream.

``stream_class_stats`` appends a window when the watermark has closed it, so the last windows of an input that ends stay in its
state. ``run_intake`` loses nothing: each micro-batch writes the sums of its new records and the list of those it did not
take, both under the batch's number, so a repeated batch overwrites itself; ``intake_stats`` adds the sums up and so has every
window at any time, the last ones too.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import constants as K

#: Groups of records that share a state; each holds the records of the watermark's span whose key falls to it.
BUCKETS = 64
NEW, REPEATED, LATE = "new", "repeated", "late"


def _stats(records: DataFrame, window: str) -> DataFrame:
    ok = F.coalesce("system_error", F.lit("")) == ""
    slot = F.window("event_time", window)
    return records.where(ok).groupBy(slot.alias("slot"), "class_id", "item_id").agg(
        F.count("*").alias("counted"), F.count_if(F.col("verdict") == "hit").alias("hit"),
        F.count_if(F.col("verdict") == "partial").alias("partial"),
        F.count_if(~F.col("verdict").isin("hit", "partial")).alias("miss"),
        F.sum("score").alias("score_sum"), F.count_if("needs_review").alias("needs_review")).select(
        F.col("slot.start").alias("window_start"), F.col("slot.end").alias("window_end"), "class_id", "item_id",
        "counted", "hit", "partial", "miss", "score_sum", "needs_review")


def stream_class_stats(records: DataFrame, window: str = "1 day", lateness: str = "1 hour",
                       key: str = "record_id") -> DataFrame:
    """Item statistics per class and time window.

    On a stream, repeated records are dropped within the watermark and rows later than it are ignored;
    state is bounded by the watermark. On a batch table every record counts once.
    """
    if records.isStreaming:
        once = records.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])
    else:
        once = records.dropDuplicates([key])
    return _stats(once, window)


def daily_quota(calls: DataFrame, limit: int = K.DAILY_QUOTA, lateness: str = "1 hour") -> DataFrame:
    """(day, session_id, used, remaining, exhausted) of the shared channel; a limit of 0 means unlimited."""
    if calls.isStreaming:
        calls = calls.withWatermark("event_time", lateness)
    used = calls.groupBy(F.window("event_time", "1 day").alias("slot"), "session_id").agg(F.count("*").alias("used"))
    left: Column = F.greatest(F.lit(limit) - F.col("used"), F.lit(0))
    return used.select(F.col("slot.start").alias("day"), "session_id", "used", left.alias("remaining"),
                       (F.lit(limit > 0) & (F.col("used") >= limit)).alias("exhausted"))


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything there is, then stop; closed windows are appended to a parquet folder.

    ``checkpoint`` must be on storage all executors reach, so that a lost executor only repeats its task.
    """
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        query.stop()


def label_records(records: DataFrame, lateness: str = "1 hour", key: str = "record_id", buckets: int = BUCKETS) -> DataFrame:
    """A stream of records with ``status``: new, repeated (its key has come before) or late (older than the watermark).

    Nothing is dropped. The state of a bucket holds the keys, as 64 bits of a hash, and times of records that the watermark has
    not passed; older ones are forgotten, as a copy of theirs is late itself. Records without a time or a key are new.
    """
    micros = F.unix_micros("event_time").alias("_at")
    code = F.xxhash64(F.col(key).cast("string")).alias("_code")
    dealt = records.withWatermark("event_time", lateness).select("*", micros, code, F.col(key).isNull().alias("_no_key")).withColumn(
        "_bucket", F.pmod("_code", F.lit(buckets)).cast("int"))
    names = records.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in records.dtypes) + ", status string"

    def label(bucket, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = state.getCurrentWatermarkMs() * 1000
        codes, times = (np.frombuffer(b, np.int64) for b in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for chunk in chunks:
            at = chunk["_at"].to_numpy(np.float64, na_value=np.nan)
            code = chunk["_code"].to_numpy(np.int64)
            free = chunk["_no_key"].to_numpy(bool)
            late = at < past
            again = ~free & ~late & (np.isin(code, codes) | pd.Series(np.where(late | free, np.arange(len(code)) - len(code), code)).duplicated().to_numpy())
            fresh = ~again & ~late & ~free
            codes, times = np.concatenate((codes, code[fresh])), np.concatenate((times, np.nan_to_num(at[fresh], nan=2.0 ** 62).astype(np.int64)))
            yield chunk[names].assign(status=np.select([late, again], [LATE, REPEATED], NEW))
        live = times >= past
        state.update((codes[live].tobytes(), times[live].tobytes()))

    return dealt.groupBy("_bucket").applyInPandasWithState(label, schema, "codes binary, times binary", "append", GroupStateTimeout.NoTimeout)


def run_intake(records: DataFrame, folder: str, window: str = "1 day", lateness: str = "1 hour", key: str = "record_id") -> None:
    """Take in everything there is of a stream, then stop; run again with the same folder to go on where it ended.

    ``folder`` must be on storage all executors reach. It holds the checkpoint, the sums and the rejected records of each batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        taken = f"{folder}/taken/batch={number}"
        batch.write.mode("overwrite").parquet(taken)
        labelled = batch.sparkSession.read.schema(batch.schema).parquet(taken)
        _stats(labelled.where(F.col("status") == NEW), window).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        labelled.where(F.col("status") != NEW).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")

    query = (label_records(records, lateness, key).writeStream.outputMode("append").foreachBatch(write)
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        query.stop()


def intake_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Item statistics per class and window over all that ``run_intake`` has taken in, open windows included."""
    sums = spark.read.parquet(f"{folder}/sums")
    figures = [c for c in sums.columns if c not in ("window_start", "window_end", "class_id", "item_id", "batch")]
    return sums.groupBy("window_start", "window_end", "class_id", "item_id").agg(*[F.sum(c).alias(c) for c in figures])


def rejected_records(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated and late records, whole, with their ``status`` and the number of the ``batch`` that met them."""
    return spark.read.parquet(f"{folder}/rejected")
