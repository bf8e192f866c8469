"""Parsing of model output strings: native first, the Arrow helper sees only what the native parser rejects."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfix
from ..functions.jsonfix import repair

# the helper travels with the plan, so executors need no copy of this package
for _module in (jsonfix, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

_FIXED = T.StructType([T.StructField("json", T.StringType()), T.StructField("repaired", T.BooleanType())])


@F.pandas_udf(_FIXED)
def _repair(raw: pd.Series) -> pd.DataFrame:
    fixed = [repair(r) for r in raw]
    return pd.DataFrame({"json": [j for j, _ in fixed], "repaired": [r for _, r in fixed]})


def parse_model_json(df: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (struct of ``schema``, NULL when hopeless) and ``repaired``.

    Valid rows pass the helper as NULL, so their text is never sent to Python.
    """
    valid = F.try_parse_json(F.col(raw)).isNotNull()
    marked = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    fixed = marked.withColumn("_fixed", _repair(F.when(~F.col("_valid"), F.col(raw))))
    text = F.when(F.col("_valid"), F.col(raw)).otherwise(F.col("_fixed.json"))
    return fixed.withColumns({
        "parsed": F.from_json(text, schema),
        "repaired": ~F.col("_valid") & F.coalesce("_fixed.repaired", F.lit(False))}).drop("_valid", "_fixed")
