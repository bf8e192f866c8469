"""History of checks: one table for all visitors and archives.

history(sid, archive_key, name, saved_at, seq, entry_id, total, ...); ``sid`` is the visitor's space.
Stored partitioned by ``sid`` bucket it prunes to one visitor; every function also works on the whole table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbering import scan_groups
from ..functions.rows import first_row, top_k
from .redact import safe_name

ARCHIVE = ["sid", "archive_key"]
SID_SHAPE = "^[0-9a-f]{8,64}$"


def append_history(entries: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Entries ready to append: clean archive key, and a sequence number among entries of one instant.

    Nothing is ever overwritten: numbers continue after those already stored for the same instant. They follow ``entry_id``.
    A bulk import may put any number of entries at one instant: its entries are numbered by many tasks.
    """
    keyed = entries.withColumn("archive_key", safe_name(F.col("name")))
    instant = ARCHIVE + ["saved_at"]
    numbered = scan_groups(keyed, instant, ["entry_id"], "seq").withColumn("seq", F.col("seq").cast("int"))
    if stored is None:
        return numbered
    taken = stored.groupBy(*instant).agg(F.max("seq").alias("_taken"))
    return numbered.join(taken, instant, "left").withColumn(
        "seq", (F.col("seq") + F.coalesce("_taken", F.lit(0))).cast("int")).drop("_taken")


def load_history(history: DataFrame, sid: str | None = None, archive_key: str | None = None) -> DataFrame:
    """Readable entries in time order (a distributed sort); the filters prune before anything is read."""
    out = history.where(F.col("saved_at").isNotNull() & F.col("total").isNotNull())
    if sid is not None:
        out = for_space(out, sid)
    if archive_key is not None:
        out = out.where(F.col("archive_key") == archive_key)
    return out.orderBy(*ARCHIVE, "saved_at", "seq")


def history_index(history: DataFrame) -> DataFrame:
    """(sid, archive_key, name, saved_at, entries): name of the last entry, newest archive first when ordered."""
    last = F.max(F.struct("saved_at", "seq", "name"))
    return history.groupBy(*ARCHIVE).agg(last.alias("_last"), F.count("*").alias("entries")).select(
        *ARCHIVE, F.coalesce("_last.name", "archive_key").alias("name"), F.col("_last.saved_at").alias("saved_at"), "entries")


def trend(history: DataFrame) -> DataFrame:
    """Every total with the change since the entry before it; a missing total counts as 0.

    Steps are taken inside sorted ranges, and the last total of a range is carried into the next: neither an archive nor an
    hour or instant of it is ever one task. Entries without a time come first.
    """
    rows = history.select(*ARCHIVE, "saved_at", "seq", F.coalesce("total", F.lit(0)).alias("total"))
    return scan_groups(rows, ARCHIVE, ["saved_at", "seq"], previous={"_last": "total"}).select(
        *ARCHIVE, "saved_at", "seq", "total", (F.col("total") - F.col("_last")).alias("step"))


def trend_change(history: DataFrame) -> DataFrame:
    """(sid, archive_key, entries, first_total, last_total, change): plain aggregates, no window."""
    total = F.coalesce("total", F.lit(0))
    ends = history.groupBy(*ARCHIVE).agg(
        F.count("*").alias("entries"), F.min(F.struct("saved_at", "seq", total.alias("total"))).alias("_a"),
        F.max(F.struct("saved_at", "seq", total.alias("total"))).alias("_b"))
    return ends.select(*ARCHIVE, "entries", F.col("_a.total").alias("first_total"), F.col("_b.total").alias("last_total"),
                       (F.col("_b.total") - F.col("_a.total")).alias("change"))


def latest_two(history: DataFrame) -> DataFrame:
    """(sid, archive_key, entry_id, previous_id): the last two entries of each archive, ready for a version diff."""
    two = top_k(history, ARCHIVE, [F.desc("saved_at"), F.desc("seq")], 2, "age")
    return two.groupBy(*ARCHIVE).agg(
        F.max(F.when(F.col("age") == 1, F.col("entry_id"))).alias("entry_id"),
        F.max(F.when(F.col("age") == 2, F.col("entry_id"))).alias("previous_id"),
        F.max(F.when(F.col("age") == 1, F.col("total"))).alias("total"),
        F.max(F.when(F.col("age") == 2, F.col("total"))).alias("previous_total")).where("previous_id is not null")


def delete_entries(history: DataFrame, keys: DataFrame) -> DataFrame:
    """What is left after deleting; ``keys`` names entries (entry_id) or whole archives (sid, archive_key)."""
    on = ["entry_id"] if "entry_id" in keys.columns else ARCHIVE
    return history.join(keys.select(*on).distinct(), on, "left_anti")


def for_space(history: DataFrame, sid: str) -> DataFrame:
    """One visitor's rows; anything but 8-64 hex digits is refused."""
    import re
    if not re.match(SID_SHAPE, sid or ""):
        raise ValueError("a space id is 8 to 64 hex digits")
    return history.where(F.col("sid") == sid)


def valid_spaces(history: DataFrame) -> DataFrame:
    """Rows whose space id has the legal shape."""
    return history.where(F.col("sid").rlike(SID_SHAPE))


def stale_spaces(history: DataFrame, now: Column, days: int = K.HISTORY_RETENTION_DAYS) -> DataFrame:
    """(sid, newest): spaces untouched for longer than the retention time."""
    newest = history.groupBy("sid").agg(F.max("saved_at").alias("newest"))
    return newest.where(F.col("newest") < now - F.make_interval(days=F.lit(days)))


def sweep_stale(history: DataFrame, now: Column, days: int = K.HISTORY_RETENTION_DAYS) -> DataFrame:
    """The history without its stale spaces."""
    return history.join(stale_spaces(history, now, days).select("sid"), "sid", "left_anti")


def space_quota(history: DataFrame, limit: int = K.MAX_SPACES) -> DataFrame:
    """(spaces, can_open): exact number of spaces, counted in two stages."""
    n = F.count("*")
    return history.select("sid").distinct().agg(n.alias("spaces"), (n < limit).alias("can_open"))


def known_spaces(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidate ids that already have a space."""
    return candidates.join(history.select("sid"), "sid", "left_semi")


def current_entries(history: DataFrame) -> DataFrame:
    """The newest entry of every archive."""
    return first_row(history, ARCHIVE, [F.desc("saved_at"), F.desc("seq")])
