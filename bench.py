"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR  tables to read          (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores to use      (default: all)
    BENCH_QUERIES comma-separated names   (default: HEADLINE)

Every query is computed whole and discarded (the ``noop`` sink), once cold and then
``BENCH_RUNS`` times warm (default 2); the reported figure is the median warm run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

import pyarrow.parquet as pq

from replylens.plans import load_all
from replylens.plans.registry import QUERIES
from replylens.session import build_session

HEADLINE = [
    "J1_reply_pairs", "A1_brand_comparison", "A25_threshold_sensitivity", "A26_duplicate_rate",
    "W5_prior_messages", "W9_recent_turns", "P2_substantive_reply", "T2_near_duplicate_key",
    "T4_hardness", "T6_redact", "T7_tokens", "S1_seeded_sample", "W2_per_class_sample",
    "W7_hard_stratum", "J7_ordered_lookup", "J8_nearest", "J8_nearest_approximate",
    "T8_S4_bm25_search", "J9_live_passage_evidence", "R1_policy_documents", "R3_decision",
    "R6_routing", "A7_per_class_scores", "A12_kappa", "A16_dimension_agreement",
    "A19_A20_config_summary", "A24_threshold_what_if", "A28_reconciliation_counts",
    "IO6_result_store", "M1_batch_scoring", "M2_text_classifier", "M4_config_comparison",
    "W11_client_caps", "ST3_usage_counts", "ST1_stream_triage",
]


def split_tables(sf: str, parts: int) -> str:
    """A copy of the tables with row groups enough for every core: a row group is not split.

    The given tables are one row group each; real ones have many. Not part of any timing.
    """
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in os.listdir(sf):
        whole = pq.read_table(os.path.join(sf, name))
        pq.write_table(whole, os.path.join(folder, name), row_group_size=max(1, -(-whole.num_rows // parts)))
    return folder


def main() -> None:
    sf = given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    load_all()
    sf = split_tables(given, 2 * cores)
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cores),
                          spark__sql__files__maxPartitionBytes="1m",
                          spark__sql__files__openCostInBytes="0",
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    warm, cold = {}, {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold, "sf": given, "cpus": cores,
                      "runs": runs}))


if __name__ == "__main__":
    main()
