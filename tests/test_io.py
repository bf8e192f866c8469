"""Readers, sinks, model output strings, streaming."""
import json

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import jsonfix
from gradeframe.operators.model_json import parse_model_json
from gradeframe.sources import readers, sinks
from gradeframe.streaming import intake

# (answer, expected object, whether the format had to be repaired)
ANSWERS = [
    ('{"grade": 4, "remark": "clear"}', {"grade": 4, "remark": "clear"}, False),
    ('Sure! {"grade": 2, "remark": "short"} Anything else?', {"grade": 2, "remark": "short"}, False),
    ('```\n{"grade": 1, "remark": "late"}\n```', {"grade": 1, "remark": "late"}, False),
    ('{"remark": "the so-called "control" arm, and "blind" too", "grade": 3}', {"remark": 'the so-called "control" arm, and "blind" too', "grade": 3}, True),
    ('{"tags": ["a "b" c", "d"], "grade": 0}', {"tags": ['a "b" c', "d"], "grade": 0}, True),
    ('{"remark": "tab\there\nand line", "grade": 5}', {"remark": "tab\there\nand line", "grade": 5}, True),
    ('{"grade": 7, "remark": "cut in the mid', {"grade": 7, "remark": "cut in the mid"}, True),
    ('{"grade": 7, "tags": ["x", "y', {"grade": 7, "tags": ["x", "y"]}, True),
    ('{"grade": 7, "tags": ["x"], "rem', {"grade": 7, "tags": ["x"]}, True),
    ('{"grade": 7, "remark":', {"grade": 7}, True),
    ('{"grade": 7, "nested": {"p": {"q": [1, 2', {"grade": 7, "nested": {"p": {"q": [1, 2]}}}, True),
    ('{"grade": 8, "remark": "path C:\\dir", }', {"grade": 8, "remark": "path C:\\dir"}, True),
    ('{"grade": 9, "tags": ["x", "y"}', {"grade": 9, "tags": ["x", "y"]}, True),
    ('{"grade": 9, "odd": {"lonely"}, "remark": "z"}', {"grade": 9, "odd": {}, "remark": "z"}, True),
    ('```json\n{"grade": 6, "remark": "say "hi""}\n```', {"grade": 6, "remark": 'say "hi"'}, True),
]


@pytest.mark.parametrize("raw, want, repaired", ANSWERS)
def test_repair(raw, want, repaired):
    text, changed = jsonfix.repair(raw)
    assert json.loads(text) == want and changed == repaired


def test_hopeless_answers():
    assert [jsonfix.repair(r) for r in (None, "", "no object", "} ] :")] == [(None, False)] * 4
    assert jsonfix.repair("{")[0] == "{}"


def test_repair_of_long_answers():
    """A cut answer of 100 kB keeps all but its unfinished end, and every cut of a small one gives an object."""
    body = ", ".join(f'"point {i}, said "so""' for i in range(4500))
    text, changed = jsonfix.repair('{"points": [' + body[:-5])
    got = json.loads(text)["points"]
    assert changed and len(body) > 100_000 and len(got) == 4500 and got[4498] == 'point 4498, said "so"'
    whole = '{"a": [1, {"b": "x, "y" z"}, null], "c": {"d": true, "e": "f"}}'
    for end in range(1, len(whole)):
        assert isinstance(json.loads(jsonfix.repair(whole[:end])[0]), dict)


def test_parsed_answers(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(ANSWERS)] + [(99, "nothing"), (98, None)], "id int, raw string")
    got = {r.id: r for r in parse_model_json(df, "grade int, remark string, tags array<string>").collect()}
    for i, (_, want, repaired) in enumerate(ANSWERS):
        assert (got[i].parsed.grade, got[i].parsed.remark, got[i].parsed.tags) == (want.get("grade"), want.get("remark"), want.get("tags"))
        assert got[i].repaired == repaired
    assert got[99].parsed is None and got[98].parsed is None


def test_read_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("一　二\r\n三".encode() + b"\xff")
    (tmp_path / "b.md").write_text("x", encoding="utf-8")
    (tmp_path / "c.pdf").write_text("no", encoding="utf-8")
    got = {r.report_id: r.raw_text for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"a": "一 二\n三", "b.md": "x"}


def test_graded_batches_tolerate_old_shapes(spark, tmp_path):
    detail = {"id": "r1", "v": "hit", "s": "13.5", "max": "15"}
    (tmp_path / "a.json").write_text(json.dumps({"config": {"course": "java"}, "results": [{"report_id": "x", "total": "80", "details": [detail]}]}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"course": "top", "reports": [{"report_id": "y", "details": [{"id": "r1", "verdict": "miss", "s": 0, "max": 15}]}]}, indent=1), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"reports": [{"report_id": "z", "details": []}]}), encoding="utf-8")
    (tmp_path / "d.json").write_text("{ broken", encoding="utf-8")
    (tmp_path / "e.json").write_text(json.dumps([{"report_id": "w", "total": 5, "details": [detail]}]), encoding="utf-8")
    batches = readers.read_graded_batches(spark, str(tmp_path))
    assert {(r.report_id, r.course) for r in batches.collect()} == {("x", "java"), ("y", "top"), ("w", "")}
    rows = {r.report_id: r for r in readers.batch_details(batches).collect()}
    assert (rows["x"].verdict, float(rows["x"].score), rows["y"].verdict, rows["y"].item_name) == ("hit", 13.5, "miss", "r1")


def test_batches_are_never_overwritten(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "store")
    sinks.write_batch(df, path, "a", "2024-01-01")
    sinks.write_batch(df, path, "b", "2024-01-02", partial=True)
    pointer = spark.read.parquet(f"{path}/pointer")
    assert sinks.latest_batch(pointer).first().batch_id == "a"
    assert [r.batch_id for r in sinks.list_batches(pointer).collect()] == ["b", "a"]
    with pytest.raises(Exception):
        sinks.write_batch(df, path, "a", "2024-01-03")


def test_publication_gate_blocks(spark, tmp_path):
    cases = spark.createDataFrame([("S1", "mail a@b.com", True)], "report_id string, public_text string, is_public boolean")
    with pytest.raises(ValueError):
        sinks.write_public_cases(cases, str(tmp_path / "public"))
    assert not (tmp_path / "public").exists()


def test_bundle_forms(spark, tmp_path):
    good = {"name": "r", "saved_at": "2024-01-01T10:00:00.000", "result": {"total": 40.0, "items": []}}
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "items": [good, {"name": "junk"}, 5]}), encoding="utf-8")
    got = readers.read_bundle(spark, str(tmp_path / "a.json")).collect()
    assert len(got) <= 1
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "items": [good, {"name": "junk"}]}), encoding="utf-8")
    assert [(r.name, r.total) for r in readers.import_bundle(spark, str(tmp_path / "b.json")).collect()] == [("r", 40.0)]
    (tmp_path / "c.json").write_text("hello", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.import_bundle(spark, str(tmp_path / "c.json"))


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(200).select(
        (F.col("id") % 150).alias("record_id"), F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 150) * 3000).alias("event_time"),
        F.lit("c").alias("class_id"), F.lit("r1").alias("item_id"), F.lit("hit").alias("verdict"), F.lit(1).alias("score"),
        F.lit(False).alias("needs_review"), F.lit("").alias("system_error"))
    rows.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    intake.run_available(intake.stream_class_stats(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = {r.window_start: r.counted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.window_start: r.counted for r in intake.stream_class_stats(rows).collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items()) and len(batch) - len(streamed) <= 1


def test_reports_of_one_name_stay_apart(spark, tmp_path):
    for folder, name in (("x", "r.txt"), ("y", "r.txt"), ("y", "r.md"), ("y", "a b+ü.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(folder, encoding="utf-8")
    got = readers.read_reports(spark, str(tmp_path)).collect()
    assert {(r.report_id, r.name) for r in got} == {("x/r", "r"), ("y/r", "r"), ("y/r.md", "r"), ("y/a b+ü", "a b+ü")}


def test_bundle_layouts(spark, tmp_path):
    """An indented document and a bare list carry whole results; what cannot be read is listed."""
    entry = {"name": "n", "saved_at": "2024-02-03T04:05:06", "result": {"report_id": "q", "total": 55, "items": [
        {"name": "i", "score": 5, "status": "ok", "issues": [{"problem": "p", "location": "l", "impact": "m", "direction": "d"}]}]}}
    bad = [{"name": "x", "result": {"items": []}}, {"name": "y"}]
    for k, doc in enumerate(({"sid": "abcdef01", "items": [entry, *bad]}, [entry, *bad])):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
        got = readers.import_bundle(spark, str(tmp_path / f"{k}.json"), whole_documents=True).collect()
        assert [(r.report_id, r.total, r["items"][0].issues[0].direction, str(r.saved_at)) for r in got] == [("q", 55.0, "d", "2024-02-03 04:05:06")]
        out = readers.rejected_bundle_items(spark, str(tmp_path / f"{k}.json"), whole_documents=True).collect()
        assert {(r.name, r.reason) for r in out} == {("x", "no_total"), ("y", "no_result")}


def test_public_cases_are_checked_as_written(spark, tmp_path):
    cases = spark.createDataFrame([("a", "text", True), ("b", "mail me@example.org", True)], "report_id string, public_text string, is_public boolean")
    with pytest.raises(ValueError):
        sinks.write_public_cases(cases, str(tmp_path / "p"))
    assert not (tmp_path / "p" / "manifest").exists() and not (tmp_path / "p" / "cases").exists()
    sinks.write_public_cases(cases.limit(1), str(tmp_path / "p"), "a")
    assert [r.report_id for r in spark.read.json(str(tmp_path / "p" / "manifest")).collect()] == ["a"]


def test_every_document_is_taken_or_listed(spark, tmp_path):
    texts = {"good.json": '{"reports": [{"report_id": "a", "details": [{"id": "r1", "v": "hit"}]}, {"report_id": "b"}]}', "list.json": '[{"report_id": "c", "details": [{"id": "r1"}]}]',
             "broken.json": '{"reports": [', "badlist.json": "[1, 2", "none.json": '{"version": "v1"}', "empty.json": " \n", "blank.json": '{"results": [{"report_id": "x", "details": []}]}',
             "other.json": '{"reports": "text"}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rejected = {r.file.rsplit("/", 1)[1]: (r.reason, r.value) for r in readers.rejected_batches(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in rejected.items()} == {"broken.json": "unreadable", "badlist.json": "unreadable", "none.json": "no_reports", "empty.json": "unreadable",
                                                      "blank.json": "no_judgements", "other.json": rejected["other.json"][0]}
    assert all(v[1] == texts[k] for k, v in rejected.items())
    taken = {r.file.rsplit("/", 1)[1] for r in readers.read_graded_batches(spark, str(tmp_path)).collect()}
    assert taken == {"good.json", "list.json"} and taken | set(rejected) == set(texts)
    assert [r.report_id for r in readers.read_graded_batches(spark, str(tmp_path)).where("details IS NULL").collect()] == ["b"]


def test_every_stored_result_is_taken_or_listed(spark, tmp_path):
    lines = ['{"report_id": "a", "judgements": []}', '{"_meta": {"engine": "m"}, "result": {"report_id": "b", "judgements": [{"rubric_item_id": "r1"}]}}',
             '{"report_id": "c"}', "{", "no", '{"_meta": {}, "result": {"report_id": "d"}}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n\n")
    got = {r.report_id for r in readers.read_preset_results(spark, str(tmp_path), one_per_line=True).collect()}
    rejected = {r.value: r.reason for r in readers.rejected_presets(spark, str(tmp_path), one_per_line=True).collect()}
    assert got == {"a", "b"} and rejected == {lines[2]: "no_judgements", "{": "unreadable", "no": "unreadable", lines[5]: "no_judgements"}


def test_a_nul_byte_anywhere_keeps_a_text_out(spark):
    rows = [("a.txt", 9000, bytearray(b"x" * 8000 + b"\x00" + b"y")), ("b.txt", 5, bytearray(b"plain")), ("c.md", 0, bytearray(b"")), ("d.pdf", 9, bytearray(b"%PDF-1\x00"))]
    got = {r.path: r.admitted for r in readers.admit_files(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert got == {"a.txt": False, "b.txt": True, "c.md": True, "d.pdf": True}
