"""Texts kept as a table bucketed by ``report_id``: joins on the report neither shuffle nor sort the texts again.

A text is canonicalised and sectioned once, when it is written. Whatever meets it later by ``report_id`` (answers, quotes,
results) is shuffled into the table's buckets, texts stay where they are. The number of buckets is part of the table; take it
from the size that the texts will reach (``buckets_for``), as a bucket is the unit of a join task.
"""

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

BUCKET_BYTES = 128 << 20


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two of buckets of about ``bucket_bytes``, so that tables of different size still line up."""
    return 1 << max(0, math.ceil(math.log2(max(1, total_bytes / bucket_bytes))))


def write_text_table(texts: DataFrame, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Write ``texts`` as a new bucketed table (below the shared folder unless ``path`` says else) and return its name.

    Rows are dealt by the bucketing hash first, so each bucket is one sorted file and reading needs no merge of files.
    """
    spark = texts.sparkSession
    name = name or f"texts_{uuid.uuid4().hex}"
    dealt = texts.repartition(buckets, "report_id")
    dealt.write.bucketBy(buckets, "report_id").sortBy("report_id").option("path", path or scratch(spark, name)).saveAsTable(name)
    return name


def read_text_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def text_bytes(texts: DataFrame, column: str = "full_text") -> int:
    """Bytes of all texts, the number that ``buckets_for`` takes."""
    return texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
