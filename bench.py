"""Headline queries over the whole corpus; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  A query's time covers
building the plan, running it and consuming every row.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rivulint.checks.queries import QUERIES  # noqa: E402
from rivulint.session import build_session  # noqa: E402

HEADLINE = [
    "agg7_language_matrix", "rul_s_scan_findings", "rul_a_audit_findings", "review_all_checks",
    "agg11_summary_once", "rv01_sql_injection", "rv02_dynamic_sql", "rv06_command_injection",
    "rv16_hardcoded_credential", "rv24_duplicate_function", "pos1_match_places",
    "jn1_rules_by_join", "jn3_context_five", "agg4_by_severity", "top1_files",
    "top2_category_samples", "srt1_sorted_findings", "set2_first_of_key",
    "str2_running_language", "snk8_finding_store",
]
WARM_DIR = "/root/testdata/sf0.001"


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if os.path.isdir(WARM_DIR):
        run(QUERIES["agg7_language_matrix"], spark, WARM_DIR)
    seconds = {name: round(run(QUERIES[name], spark, sf_dir), 3) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)", os.path.basename(sf_dir.rstrip("/")))
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else None,
        "cpus": int(cpus), "files": files,
        "files_per_second": {
            profile: round(files / seconds[name])
            for profile, name in (("scan", "rul_s_scan_findings"), ("audit", "rul_a_audit_findings"),
                                  ("review", "review_all_checks"))
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
