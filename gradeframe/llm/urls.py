"""URL rules by a sort-merge range join over reversed hosts.

A rule is (verdict, host, path prefix); it fits its host and all subdomains if the url's path starts with the rule's. With the
labels of a host reversed and ended by dots (``www.example.net`` -> ``net.example.www.``) the hosts of a rule are one interval
of keys, from its own key up to the same key with the last ``.`` raised to ``/``. Path prefixes stand before the host: a
page asks once for each length that rule paths have, with that much of its path. Pages' keys and rules' starts are sorted
together; a sweep keeps the stack of rules whose interval is open, and the top of the stack is the longest host that fits.

The sweep is cut into ranges of keys. A rule is sent to each range that its interval reaches, so every sweep starts with
the right stack; intervals nest, so a range gets its own rules and at most one per host label from before it. Equal keys are swept once.

Edge cases: a null url or one without ``://`` has an empty host and path and meets no rule; equal rules count once, and of
rules with one host and path the blocking one holds; among fitting rules the longest host + path wins, then the longer
host; repeated rows and null page_ids get a row each; extra columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import staged

#: Verdict, host, path: the published test rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _key(path: Column, host: Column) -> Column:
    """Sort key: the path prefix, its end mark, the reversed host. As bytes, which is code point order."""
    return F.concat(path, F.lit("\x00"), reversed_host(host)).cast("binary")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _sweep(batches):
    """Rows of one part sorted by (key, kind): a rule's start (kind 0) opens an interval that ends at ``stop``."""
    stack: list[tuple[bytes, str, str, int]] = []
    for batch in batches:
        rows = batch.to_pydict()
        out = {"key": [], "rule": [], "verdict": [], "host_length": []}
        for key, kind, stop, rule, verdict, length in zip(*(rows[c] for c in ("key", "kind", "stop", "rule", "verdict", "host_length"))):
            while stack and stack[-1][0] <= key:
                stack.pop()
            if kind == 0:
                stack.append((stop, rule, verdict, length))
            elif stack:
                for name, value in zip(out, (key, *stack[-1][1:])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.binary()), "rule": pa.array(out["rule"], pa.string()),
                                          "verdict": pa.array(out["verdict"], pa.string()), "host_length": pa.array(out["host_length"], pa.int32())})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host + path of the one that holds, else null) and verdict (the rule's, else ``default``)."""
    spark = pages.sparkSession
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = rules.select("verdict", F.translate("host", _CAPITALS, _SMALL).alias("host"), "path").where("host <> '' AND path IS NOT NULL")
    own = own.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    key = _key(F.col("path"), F.col("host"))
    stop = F.concat(F.col("path"), F.lit("\x00"), F.regexp_replace(reversed_host(F.col("host")), r"\.$", "/")).cast("binary")
    own, _ = staged(own.select(key.alias("key"), stop.alias("stop"), F.concat("host", "path").alias("rule"), "verdict",
                               F.length("host").alias("host_length"), F.length("path").alias("n")), "url-rules")
    lengths = sorted(r[0] for r in own.select("n").distinct().collect())       # at most as many as a path has characters

    # probes: the keys of all pages, once each
    asks = F.array(*[F.struct(F.lit(n).alias("n"), _key(F.left("path", F.lit(n)), F.col("host")).alias("key")) for n in lengths]) \
        if lengths else F.array().cast("array<struct<n:int,key:binary>>")
    asked = urls.where("host <> ''").select("host", "path").distinct().select("host", "path", F.inline(asks)).where(
        F.length("path") >= F.col("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, _ = staged(asked.select("key").distinct().repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "url-keys")

    # the ranges begin at the least keys of the parts; a rule goes to all ranges from its start to its stop
    heads = sorted((bytes(r["least"]), r["part"]) for r in keys.groupBy("part").agg(F.min("key").alias("least")).collect())
    cuts, numbers = F.array(*[F.lit(k) for k, _ in heads[1:]]), F.array(*[F.lit(p) for _, p in heads])

    def place(name: str) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= F.col(name))) if len(heads) > 1 else F.lit(0)

    reach = F.sequence(place("key"), place("stop")) if heads else F.array().cast("array<int>")
    starts = own.withColumn("range", F.explode(reach)).select(
        F.get(numbers, F.col("range")).alias("part") if heads else F.lit(0).alias("part"), "key", F.lit(0).alias("kind"), "stop",
        "rule", "verdict", "host_length")
    probes = keys.select("part", "key", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("stop"),
                         F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length"))
    # of rules that start at one key there is one; a wider interval starts before a narrower one
    swept = starts.unionByName(probes).repartitionById(parts, F.col("part")).sortWithinPartitions("key", "kind").mapInArrow(
        _sweep, "key binary, rule string, verdict string, host_length int")
    held = asked.join(swept, "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))
    held = held.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", "best.verdict")
    return urls.join(held, (urls.host == F.col("_host")) & (urls.path == F.col("_path")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
