"""Times the headline queries and prints one JSON line.

Every query runs to a no-op sink, so the figures hold the Spark work and no driver-side collection. The given tables are one
file with one row group each, which Spark cannot split; they are first laid out as one file per core, as a lake would hold
them, in a folder of this run. That copy is not timed.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "e1_weak_items_of_texts", "j17_grade_offline", "j15_rule_judge", "j5_resolve_attempts", "j7_consistency_guard",
    "j8_flag_injection", "j9_flag_reused_evidence", "j13_effective_totals", "j14_export_rows", "j19_audit_results",
    "c4_class_item_stats", "c5_class_totals", "c7_student_rows", "c16_attention_list", "c17_class_actions",
    "m1_import_gold", "m5_compare_totals", "m9_traceability", "m12_benchmark_report", "m14_batch_matrix",
    "p1_verdict_stability", "p5_stability_gate", "t2_collapse_char_spacing", "t5_split_sections", "t9_parse_reports",
    "t11_recall_sections", "t13_locate_quotes", "t14_detect_injection", "r1_redact", "r6_hygiene_scan",
    "r8_clip_public_text", "b2_normalize_rubrics", "k13_rule_check", "k20_profile_matrix", "h4_trend", "h5_latest_two",
    "o4_enrich_reports", "o6_pending_pages", "s2_read_graded_batches", "j1_parse_model_json", "w1_class_stats_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-")).config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from gradeframe.plans import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    laid_out = tempfile.mkdtemp(prefix="bench-")
    for table in sorted(os.listdir(sf_dir)):
        if table.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{table}").repartition(int(cpus)).write.parquet(f"{laid_out}/{table}")
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


main()
