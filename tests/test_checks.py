"""Health check, redaction, history, transcripts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.operators import checks as C
from gradeframe.operators import history as H
from gradeframe.operators import redact as R
from gradeframe.operators import sections as S
from gradeframe.operators import transcripts as O

PHYSICS = """实验目的
用单摆的周期公式测量当地的重力加速度，并把结果与标准值作比较，判断误差的主要来源。要求写清方法。要求写清条件，说明仪器与量程，并给出预期得到的数值范围，最后说明结论如何验证。
实验原理
小角度时周期与摆长的平方根成正比。
实验步骤
1. 用刻度尺测量摆长 L = 0.800 m，重复 3 次
2. 用秒表记录 30 次全振动时间 t = 53.70 s
3. 依次取 0.900 m 与 1.000 m 再测
数据记录
表 1 原始数据
0.800  53.70
0.900  57.00
1.000  60.10
数据处理
算得 g = 9.84 m
误差分析
摆角偏差约 0.1%。
结论
结果与标准值接近。
参考文献
[1] 甲
[2] 乙
[3] 丙
"""


def lab(spark, text, profile=K.GENERAL, with_sections=False):
    df = spark.createDataFrame([(1, text, profile)], "report_id int, raw_text string, profile string")
    if with_sections:
        return S.parse_reports(df, keep_raw=True)
    return df.withColumn("sections", F.array().cast(f"array<{S.SECTION}>"))


def items(spark, text, profile=K.GENERAL):
    return {r.item: r for r in C.rule_check(lab(spark, text, profile)).collect()}


def test_catalogue():
    assert sum(w for w, _ in K.CHECK_ITEMS.values()) == 100 and len(K.CHECK_ITEMS) == 12


def test_slots_of_cut_reports_are_those_of_parsed_ones(spark):
    text = PHYSICS.replace("\n", "\r\n").replace("用单摆", "J a v a: 1 . 5 用单摆")
    df = spark.createDataFrame([(1, text, K.GENERAL), (2, "no heading", K.GENERAL)], "report_id int, raw_text string, profile string")
    for by_line in (True, False):
        cut, parsed = (sorted(map(tuple, C.slot_rows(C.map_slots(d, by_line)).collect())) for d in (S.cut_reports(df), S.parse_reports(df, keep_raw=True)))
        assert cut == parsed and any("Java: 1.5" in row[2] for row in cut)


def test_prefiltered_lines_give_the_same_counts(spark):
    lines = F.array(*map(F.lit, ("图 1", "see Figure 2: the setup", "截图3", "no mark 4", "1.5 and 2.25", "٣.٥ and 1.125", "3.5")))
    got = spark.range(1).select(C.figure_counts(lines).alias("c"), C.decimal_places(lines).alias("p")).first()
    assert (got.c.figures, got.c.uncaptioned, got.p) == (3, 2, [1, 2, 3])


def test_good_report(spark):
    got = items(spark, PHYSICS)
    assert list(got) == C.RULE_ITEMS
    assert got["结构与完整性"].score == 100 and got["步骤可复现性"].score == 100 and got["引用与格式"].score == 100
    assert got["原始数据表"].score == 100 and got["图表规范"].score == 100 and got["实验目的"].score == 100


def test_poor_report(spark):
    got = items(spark, "实验目的\n测 g。\n数据记录\n80.0  53.7\n90.0  57.0\n结论\n大概是 9.8。\n")
    assert got["单位与量纲"].status == K.WEAK and got["引用与格式"].status == K.MISSING
    assert got["结构与完整性"].status == K.MISSING and got["原始数据表"].score == 55


def test_empty_text_is_not_a_student_failure(spark):
    got = items(spark, " \n ")
    assert len(got) == 8 and all(r.status == K.MISSING and "extracted" in r.issues[0].problem for r in got.values())


@pytest.mark.parametrize("kind, profile", [
    ("计算机类实验（Java / Python / 编程）", K.COMPUTING), ("大学物理实验", K.PHYSICS), ("基础化学实验", K.CHEMISTRY), ("生物实验", K.BIOLOGY),
    ("通用理工科实验", K.GENERAL), ("生物信息学程序", K.BIOLOGY), (None, K.GENERAL)])
def test_profiles(one, kind, profile):
    assert one(p=C.pick_profile(F.lit(kind)))["p"] == profile


def test_discipline_headings(spark):
    for text, owner in (("三 试剂与仪器\n0.1000 mol/L NaOH 溶液、酚酞指示剂。\n", K.CHEMISTRY), ("三 材料与方法\n洋葱、显微镜、载玻片。\n", K.BIOLOGY)):
        for profile in K.PROFILES:
            found = {r.slot for r in C.slot_rows(C.map_slots(lab(spark, text, profile))).collect()}
            assert ("步骤可复现性" in found) is (profile == owner)


def test_empty_heading_does_not_swallow_the_next_section(spark):
    text = "运行结果\n实验结论\n" + "泛型在编译期保证类型安全。" * 5
    slots = {r.slot: r.body for r in C.slot_rows(C.map_slots(lab(spark, text, K.COMPUTING))).collect()}
    assert slots["原始数据表"] == "" and "泛型" in slots["结论与讨论"]
    assert items(spark, text, K.COMPUTING)["原始数据表"].score == 0


def test_slots_from_titles(spark):
    slots = {r.slot: r.body for r in C.slot_rows(C.map_slots(lab(spark, PHYSICS, with_sections=True))).collect()}
    assert set(slots) == set(K.SECTION_SLOTS)


def test_totals_leave_untested_out(spark):
    rows = [("a", "实验目的", 100.0, K.PASSED), ("a", "误差分析", 0.0, K.UNTESTED), ("b", "误差分析", 0.0, K.UNTESTED)]
    df = spark.createDataFrame(rows, "check_id string, item string, score double, status string")
    assert {r.check_id: r.total for r in C.check_total(df).collect()} == {"a": 100.0, "b": 0.0}
    got = {r.check_id: r for r in C.check_summary(df).collect()}
    assert got["a"].tested == 1 and got["a"].untested == ["误差分析"] and got["a"].tested_weight == 6
    assert C.checklist(df).where("check_id = 'a'").count() == 12


def test_sanitize(spark):
    issue = [("p", "l", "巨大", "补上推导" * 30)] * 5
    df = spark.createDataFrame([("a", "原理阐述", 150.0, "随便写", issue, 1), ("a", "不存在的项", 50.0, K.WEAK, [], 2)],
                               f"check_id string, item string, score double, status string, issues array<{C.ISSUE}>, seq int")
    got = {r["item"]: r for r in C.sanitize_checks(df).collect()}
    assert set(got) == set(C.AI_ITEMS)
    first = got["原理阐述"]
    assert (first.score, first.status, len(first.issues), first.issues[0].impact) == (100.0, K.WEAK, 3, "中")
    assert len(first.issues[0].direction) == 40 and got["误差分析"].status == K.UNTESTED


def test_profile_matrix(spark):
    bio = "三 材料与方法\n洋葱、显微镜；解离 5 min，漂洗 3 min，染色 3 min。\n四 实验结果\n视野中可见各期细胞。\n六 讨论\n解离时间过长会导致细胞破碎。\n"
    got = C.profile_matrix(lab(spark, bio).drop("profile")).first()
    assert got.distinct_totals > 1 and got.p5 > got.p1


def test_redaction_and_hygiene(spark):
    text = "王五 学号：2023123456 姓名：张三 电话 13812345678 邮箱 a.b@c.com 班级：一班    x"
    df = spark.createDataFrame([(1, text)], "report_id int, raw_text string")
    got = R.redact(df, names=["王五"]).first()
    assert "2023123456" not in got.redacted and "138123" not in got.redacted and "@" not in got.redacted
    assert got.hits["手机"] == 1 and got.hits["known_names"] == 1
    left = R.residual_pii(R.redact(df)).collect()
    assert left == []
    files = spark.createDataFrame([("a.py", "x\nkey sk-abcdefghijklmnopqrst\ny sk-realsecretrealsecret1"), ("b.env.example", "sk-realsecretrealsecret1"),
                                   ("c.txt", "0123456789 and\n2023123456")], "path string, text string")
    assert {(r.path, r.type, r.line) for r in R.hygiene_scan(files).collect()} == {("a.py", "密钥串", 3), ("c.txt", "疑似学号", 2)}


def test_clip_merges_and_respects_the_budget(spark):
    text = "".join(chr(0x4e00 + i) for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "短文")], "report_id int, full_text string")
    quotes = spark.createDataFrame([(1, text[1000:1020]), (1, text[1100:1120]), (1, text[3000:3010]), (1, "没有这句话呀")], "report_id int, quote string")
    spans = {r.report_id: r.spans for r in R.evidence_windows(df, quotes, 100).collect()}
    assert [(s.a, s.b) for s in spans[1]] == [(900, 1220), (2900, 3110)]
    got = {r.report_id: r.public_text for r in R.clip_public_text(df, quotes, 100, 400).collect()}
    assert got[1] == "……" + text[900:1220] + "……\n\n……" + text[2900:2980] + "……"
    assert got[2].startswith("短文")


@pytest.mark.parametrize("raw, want", [("../../a b.txt", "abtxt"), ("", "未命名报告"), ("实验-1_x", "实验-1_x"), ("x" * 99, "x" * 60)])
def test_safe_name(one, raw, want):
    assert one(n=R.safe_name(F.lit(raw)))["n"] == want


def history(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("aaaaaaaa", "r 1", t, 1, 40), ("aaaaaaaa", "r 1", t, 2, 75), ("aaaaaaaa", "r 1", t + dt.timedelta(days=3), 3, 80),
            ("bbbbbbbb", "r2", t - dt.timedelta(days=30), 4, 10)]
    return H.append_history(spark.createDataFrame(rows, "sid string, name string, saved_at timestamp, entry_id int, total int"))


def test_history(spark):
    h = history(spark)
    assert [r.total for r in H.load_history(h, "aaaaaaaa").collect()] == [40, 75, 80]
    assert {(r.total, r.step) for r in H.trend(h).where("sid = 'aaaaaaaa'").collect()} == {(40, None), (75, 35), (80, 5)}
    two = H.latest_two(h).collect()
    assert [(r.entry_id, r.previous_id) for r in two] == [(3, 2)]
    now = F.to_timestamp(F.lit("2024-01-05 00:00:00"))
    assert [r.sid for r in H.stale_spaces(h, now).collect()] == ["bbbbbbbb"]
    assert H.sweep_stale(h, now).count() == 3
    more = H.append_history(h.select("sid", "name", "saved_at", "entry_id", "total").where("entry_id = 2"), h)
    assert more.first().seq == 3
    with pytest.raises(ValueError):
        H.for_space(h, "../etc")


def test_page_text(spark):
    pages = spark.createDataFrame([(1, 2, "程序运行结果如下。", [("TABLE", "输出", "Hello")], True, "模糊", "", False), (1, 1, "", [], True, "", "x", True)],
                                  f"report_id int, page_no int, text string, images {O.IMAGES}, legible boolean, notes string, error string, cached boolean")
    got = O.page_text(O.normalize_pages(pages)).first().transcript
    assert got.index("第 1 页 OCR 转录\n\n（本页无可转录文字）") < got.index("第 2 页 OCR 转录\n\n程序运行结果如下。\n[表格] 输出：Hello\n（转录说明：模糊）")
    stats = O.page_stats(pages).first()
    assert (stats.pages_read, stats.cached_hits, stats.images, stats.failed) == (2, 1, 1, 1)


def test_cut_bodies_are_marked_and_limits_are_parameters(spark):
    long = "实验结论\n" + "\n".join(f"this line number {i} goes on for more than thirty characters" for i in range(60))
    df = lab(spark, long)
    got = {r.slot: r for r in C.slot_rows(C.map_slots(df)).collect()}
    assert got["结论与讨论"].cut and got["结论与讨论"].body.count("\n") < 45
    whole = {r.slot: r for r in C.slot_rows(C.map_slots(df, most_lines=100, most_chars=10 ** 6)).collect()}
    assert not whole["结论与讨论"].cut and whole["结论与讨论"].body.count("\n") == 59
    short = {r.slot: r for r in C.slot_rows(C.map_slots(lab(spark, "实验结论\nwell, it worked as we had hoped it would do\n"))).collect()}
    assert not short["结论与讨论"].cut


def test_tied_profiles_are_named(spark):
    row = C.profile_matrix(lab(spark, "nothing in here").drop("profile")).first()
    assert row.distinct_totals >= 1 and sum(len(g) for g in row.tied) <= len(K.PROFILES)
    totals = [row[f"p{i}"] for i in range(1, len(K.PROFILES) + 1)]
    want = [[n for n, t in zip(K.PROFILES, totals) if t == x] for x in dict.fromkeys(totals)]
    assert row.tied == [g for g in want if len(g) > 1]
