"""Row selection helpers shared by the operators."""

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The k first rows of each group.

    A row_number filter with a constant limit: Spark keeps only k rows per group and input task
    before the exchange, so one huge group never reaches a single task whole.
    """
    ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank or "_rank") <= k)
    return kept if rank else kept.drop("_rank")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A one-element generator: filters and projections above it keep reading the result. A plain column
    of a costly expression would be copied into every filter and lambda that mentions it.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def literal_table(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A small table written in code. Its size is known to the planner, so joins with it need no shuffle."""
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]
    text = json.dumps([dict(zip(names, r)) for r in rows], ensure_ascii=False)
    typed = F.from_json(F.lit(text), f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in _top_level(schema))}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(typed))


def _top_level(schema: str) -> list[str]:
    return re.split(r",(?![^<>]*>)", schema)


def require_clean(problems: DataFrame, what: str, show: int = 20) -> None:
    """Raise when a problem table has rows. The only action behind a gate; shows at most ``show`` rows."""
    found = problems.limit(show).collect()
    if found:
        listed = "; ".join(str(r.asDict()) for r in found)
        raise ValueError(f"{what}: {listed}")
