"""Readers: report texts, graded batches, preset results, score sheets, seal records, history bundles, uploads."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.numbers import SCORE
from ..functions.rows import once
from .sinks import CHECK_RESULT

_DETAIL = ("struct<id:string,name:string,verdict:string,v:string,s:string,max:string,confidence:string,"
           "needs_review:boolean,system_error:string,evidence:array<string>,dropped:array<string>>")
_REPORT = (f"struct<report_id:string,name:string,total:string,ai_total:string,chars:string,coverage:string,"
           f"total_incomplete:boolean,elapsed_sec:string,run_info:struct<calls:bigint,tokens:bigint,failed_calls:bigint>,"
           f"details:array<{_DETAIL}>>")
BATCH_SCHEMA = (f"version string, created_at string, course string, engine string, config struct<course:string,"
                f"rubric_type:string,enable_recheck:boolean,model:string>, reports array<{_REPORT}>, "
                f"results array<{_REPORT}>, details array<{_REPORT}>")
_JUDGED = ("struct<rubric_item_id:string,verdict:string,score:string,confidence:string,reason:string,needs_review:boolean,"
           "system_error:string,dropped_quotes:array<string>,evidence:array<struct<section_id:string,quote:string,char_start:int>>>")
_RESULT = f"report_id string, total string, ai_total string, total_incomplete boolean, model string, judgements array<{_JUDGED}>"


def valid_utf8(c: Column) -> Column:
    """The text without its undecodable bytes."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per .txt / .md file below ``path``: (report_id, name, path, raw_text).

    The id is the file's place below ``path``, without the suffix .txt; others keep theirs. So files of one name in two
    folders, and ``r.txt`` beside ``r.md``, stay apart. ``name`` is the bare file name for display.
    """
    root = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/"))
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}")
             .text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))
    below = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), f"^.*?{root}/", "")
    return files.select(
        F.regexp_replace(below, r"\.txt$", "").alias("report_id"), F.regexp_extract(below, r"([^/]*)\.[^./]*$", 1).alias("name"), "path",
        X.normalize_newlines(valid_utf8(F.col("value"))).alias("raw_text"))


def _documents(spark: SparkSession, path: str, one_per_line: bool) -> DataFrame:
    return spark.read.text(path, wholetext=not one_per_line).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value"))


#: Why a document is not taken. Every document of a folder is either taken or listed under one of these.
UNREADABLE, NO_REPORTS, NO_JUDGEMENTS = "unreadable", "no_reports", "no_judgements"
_CORRUPT = "_corrupt_record"


def batch_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per graded batch document, taken or not: its text, what was read from it, and ``reject`` (NULL: taken).

    ``read_graded_batches`` and ``rejected_batches`` are the two halves of this table; write it once, by ``reject``, to have both
    from one reading. A file of no bytes at all is no document.
    """
    docs = _documents(spark, path, one_per_line).where(X.strip(F.col("value")) != "" if one_per_line else F.lit(True))
    bare = F.startswith(F.ltrim("value"), F.lit("["))

    def content(p: Column) -> Column:
        b = p["b"]
        filled = [F.when(F.size(c) > 0, c) for c in (b["results"], b["reports"], b["details"], p["list"])]
        return F.struct(b["created_at"].alias("created_at"), b["engine"].alias("engine"),
                        F.coalesce(F.nullif(b["config"]["course"], F.lit("")), b["course"], F.lit("")).alias("course"),
                        F.coalesce(*filled).alias("reports"), (p["bare"] & p["list"].isNull() | b[_CORRUPT].isNotNull()).alias("broken"))

    document = F.struct(bare.alias("bare"), F.when(~bare, F.from_json("value", f"{BATCH_SCHEMA}, {_CORRUPT} string")).alias("b"),
                        F.when(bare, F.from_json("value", f"array<{_REPORT}>")).alias("list"))
    rows = once(docs, "_c", X.bind(document, content)).select("file", "modified_at", "value", "_c.*")
    judged = F.exists("reports", lambda r: F.coalesce(F.size(r["details"]), F.lit(0)) > 0)
    broken = F.coalesce("broken", F.lit(True)) | (X.strip(F.col("value")) == "")
    return rows.withColumn("reject", F.when(F.coalesce(judged, F.lit(False)), F.lit(None)).when(broken, UNREADABLE).when(
        F.col("reports").isNull(), NO_REPORTS).otherwise(NO_JUDGEMENTS)).drop("broken")


def rejected_batches(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(file, reason, value) of every document that ``read_graded_batches`` does not take, with its whole text."""
    return batch_documents(spark, path, one_per_line).where(F.col("reject").isNotNull()).select("file", F.col("reject").alias("reason"), "value")


def read_graded_batches(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per report of every graded batch document.

    Takes the list under results, reports or details (or a bare list), the course from config before the
    top level, verdicts written as ``v``, numbers written as text. Unreadable documents and documents
    without any judgement are listed by ``rejected_batches``; a report without judgements beside others stays, without details.
    """
    usable = batch_documents(spark, path, one_per_line).where(F.col("reject").isNull())
    one = usable.select("file", "modified_at", "created_at", "engine", "course",
                        F.posexplode_outer("reports").alias("report_ord", "r"))
    return one.select(
        "file", "modified_at", "created_at", "engine", "course", "report_ord", "r.report_id",
        F.coalesce("r.name", "r.report_id").alias("name"), F.col("r.total").try_cast(SCORE).alias("total"),
        F.col("r.chars").try_cast("int").alias("chars"), F.coalesce("r.coverage", F.lit("")).alias("coverage"),
        F.coalesce("r.total_incomplete", F.lit(False)).alias("total_incomplete"),
        F.col("r.elapsed_sec").try_cast("decimal(12,2)").alias("elapsed_sec"), F.col("r.run_info").alias("run_info"),
        F.col("r.details").alias("details"))


def batch_details(batches: DataFrame, class_key: str = "file") -> DataFrame:
    """Judgement rows of read batches in the shape the class view takes."""
    rows = batches.select(F.col(class_key).alias("class_id"), "report_id", "report_ord", "course", "total", "coverage",
                          F.posexplode_outer("details").alias("pos", "d")).where("d.id is not null")
    return rows.select(
        "class_id", "report_id", "report_ord", "course", "total", "coverage", "pos", F.col("d.id").alias("item_id"), F.coalesce("d.name", "d.id").alias("item_name"),
        F.coalesce("d.verdict", "d.v").alias("verdict"), F.col("d.s").try_cast(SCORE).alias("score"),
        F.col("d.max").try_cast(SCORE).alias("max_score"), F.col("d.confidence").try_cast("double").alias("confidence"),
        F.coalesce("d.needs_review", F.lit(False)).alias("needs_review"),
        F.coalesce("d.system_error", F.lit("")).alias("system_error"),
        F.coalesce("d.evidence", F.array().cast("array<string>")).alias("evidence"),
        F.coalesce("d.dropped", F.array().cast("array<string>")).alias("dropped_quotes"))


def preset_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per stored result, taken or not: file, value, engine, full_text, the result ``r`` and ``reject`` (NULL: taken)."""
    docs = _documents(spark, path, one_per_line).where(X.strip(F.col("value")) != "" if one_per_line else F.lit(True))
    wrapped = F.from_json("value", f"_meta struct<engine:string,full_text:string,source_file:string>, "
                                   f"engine string, full_text string, result struct<{_colon(_RESULT)}>, {_CORRUPT} string")
    flat = F.from_json("value", _RESULT)
    rows = once(docs, "_d", F.struct(wrapped.alias("w"), flat.alias("f"))).select("file", "value", "_d.w", "_d.f").select(
        "file", "value", F.coalesce("w._meta.engine", "w.engine").alias("engine"),
        F.coalesce("w._meta.full_text", "w.full_text").alias("full_text"), F.coalesce("w.result", "f").alias("r"),
        (F.col(f"w.{_CORRUPT}").isNotNull() | F.col("w").isNull() | (X.strip(F.col("value")) == "")).alias("broken"))
    return rows.withColumn("reject", F.when(F.col("r.judgements").isNotNull(), F.lit(None)).when(F.col("broken"), UNREADABLE).otherwise(NO_JUDGEMENTS)).drop("broken")


def rejected_presets(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(file, reason, value) of every document that ``read_preset_results`` does not take, with its whole text."""
    return preset_documents(spark, path, one_per_line).where(F.col("reject").isNotNull()).select("file", F.col("reject").alias("reason"), "value")


def read_preset_results(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Stored results, wrapped with ``_meta`` or flat; documents that cannot be read are listed by ``rejected_presets``."""
    rows = preset_documents(spark, path, one_per_line)
    return rows.where(F.col("reject").isNull()).select(
        "file", "engine", "full_text", "r.report_id", F.col("r.total").try_cast(SCORE).alias("total"),
        F.col("r.ai_total").try_cast(SCORE).alias("ai_total"),
        F.coalesce("r.total_incomplete", F.lit(False)).alias("total_incomplete"), "r.model",
        F.col("r.judgements").alias("judgements"))


def _colon(schema: str) -> str:
    """Column list `a int, b string` as struct fields `a:int,b:string` (top level only)."""
    from ..functions.rows import _top_level
    return ",".join(p.strip().replace(" ", ":", 1) for p in _top_level(schema))


SHEET_COLUMNS = ("report_id", "item_id", "score", "verdict", "evidence", "note")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line of the text files below ``path`` with its exact number, counted from 1.

    Files are read in splits of any size. A split knows the byte at which it starts, and its lines come in order; so a line's
    number is its place in the split plus the lines of the file's earlier splits, of which there is one count each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")
    splits = splits.select("file", "_start", "_first", before.alias("_before"))
    numbered = lines.join(splits, ["file", "_start"])
    return numbered.select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value")


def read_gold_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A score sheet exported as CSV with a header in each file; every cell trimmed, rows without report or item dropped.

    ``file`` and ``row_no`` (the line in it) are the sheet's own order, whatever the splits; a row is one line.
    """
    schema = ", ".join(f"{c} string" for c in SHEET_COLUMNS)
    lines = numbered_lines(spark, path).where("line_no > 1")
    parsed = lines.select("file", F.col("line_no").alias("row_no"), F.from_csv("value", F.lit(schema)).alias("c"))
    cells = parsed.select("file", "row_no", *[X.strip(F.coalesce(f"c.{c}", F.lit(""))).alias(c) for c in SHEET_COLUMNS])
    return cells.where((F.col("report_id") != "") & (F.col("item_id") != ""))


def parse_seal(files: DataFrame, key: str = "dataset_id", content: str = "value") -> DataFrame:
    """(dataset_id, key, value): key / value rows from row 3 of each seal sheet; rows without key are skipped."""
    lines = files.select(key, F.posexplode_outer(X.lines_of(F.col(content))).alias("line_no", "line")).where("line_no >= 2")
    cells = lines.select(key, F.from_csv("line", F.lit("k string, v string")).alias("c"))
    return cells.select(key, X.strip(F.coalesce("c.k", F.lit(""))).alias("key"),
                        X.strip(F.coalesce("c.v", F.lit(""))).alias("value")).where("key <> ''")


def read_seal(spark: SparkSession, path: str) -> DataFrame:
    return parse_seal(_documents(spark, path, False).withColumnRenamed("file", "dataset_id"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content) for admission checks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def admit_files(files: DataFrame) -> DataFrame:
    """(path, extension, admitted, reason): allowed extension and bytes that agree with it; texts hold no NUL anywhere."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    looks_right = (F.when(ext.isin(".txt", ".md"), ~F.contains("content", F.lit(b"\x00")))
                   .when(ext == ".pdf", F.startswith("content", F.lit(b"%PDF-")))
                   .when(ext == ".docx", F.startswith("content", F.lit(b"PK"))).otherwise(False))
    reason = F.when(~ext.isin(*K.ADMITTED_EXTENSIONS), "extension").when(~looks_right, "content").otherwise("")
    return files.select("path", ext.alias("extension"), reason.alias("reason")).withColumn("admitted", F.col("reason") == "")


BUNDLE_ITEM = f"struct<name:string,saved_at:string,result:struct<report_id:string,total:double,items:{CHECK_RESULT}>>"


def _bundle_items(spark: SparkSession, path: str, whole_documents: bool) -> DataFrame:
    """(file, sid, i): every item of the bundles, NULL where a document or line could not be read at all."""
    docs = spark.read.text(path, wholetext=whole_documents).select(F.col("_metadata.file_path").alias("file"), "value").where(
        F.trim("value") != "")
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    parsed = docs.select("file", F.when(~bare, F.from_json("value", f"sid string, item {BUNDLE_ITEM}, items array<{BUNDLE_ITEM}>")).alias("d"),
                         F.when(bare, F.from_json("value", f"array<{BUNDLE_ITEM}>")).alias("list"))
    return parsed.select("file", "d.sid", F.explode_outer(F.coalesce("list", "d.items", F.array("d.item"))).alias("i"))


def read_bundle(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """History entries of exported bundles with their whole results: sid, name, saved_at, report_id, total and items.

    By default each line is an entry or a document of its own, so files of any size are split. ``whole_documents`` reads each
    file as one document, indented or not: an object with ``items``, or a bare list. Items without a readable result are
    listed by ``rejected_bundle_items``; the original save time is kept.
    """
    items = _bundle_items(spark, path, whole_documents)
    return items.where(F.col("i.result.total").isNotNull()).select(
        "sid", F.coalesce("i.name", F.lit("未命名报告")).alias("name"),
        F.col("i.saved_at").try_cast("timestamp").alias("saved_at"), F.coalesce("i.result.report_id", F.lit("")).alias("report_id"),
        F.col("i.result.total").alias("total"), F.col("i.result.items").alias("items"))


def rejected_bundle_items(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """(file, sid, name, reason) of everything that ``read_bundle`` cannot take."""
    items = _bundle_items(spark, path, whole_documents).where(F.col("i.result.total").isNull())
    reason = F.when(F.col("i").isNull(), "unreadable").when(F.col("i.result").isNull(), "no_result").otherwise("no_total")
    return items.select("file", "sid", F.col("i.name").alias("name"), reason.alias("reason"))


def import_bundle(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """Like ``read_bundle``, but a bundle without a single valid item is an error."""
    rows = read_bundle(spark, path, whole_documents)
    if rows.isEmpty():
        raise ValueError("no readable history entry in the bundle")
    return rows
