"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries"
{name: seconds}, "sf"}.  Each query runs to completion through the ``noop``
sink (every row and column computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.filterwarnings("ignore")

from scrubline.plans import queries as Q  # noqa: E402
from scrubline.session import local_session  # noqa: E402

HEADLINE = [
    "sanitize_default",              # 60 default rules over documents.text
    "sanitize_default_pages",        # same over raw HTML pages
    "sanitize_default_conversations",
    "detect_email",                  # one builtin detector (+ planted rows)
    "detect_hex_key",
    "resolve_conflicts",
    "detect_literal_ci",             # custom words, ~45k detections at sf0.01
    "sanitize_fixed",
    "pseudonym_email",
    "audit_stats",
    "rule_hit_counts",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="scrubline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = Q.registry()
    times = {}
    for name in HEADLINE:
        fn = reg[name][0]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
