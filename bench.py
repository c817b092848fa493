"""Times the main steps end to end; prints one JSON line.

Each step is timed on stored inputs of the steps before it, the way the job runs in practice:
raw rows -> normalized -> duplicates resolved -> classified -> statements, plans, reconciliation.
A stage's table is remembered for the session, so a step's figure leaves out the steps before it.
"""

from __future__ import annotations

import json
import os
import time

from tallybook.plans import catalog, derived, report_queries, stages
from tallybook.session import SPREAD, local_session, prepare

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

REPORTS = (
    "e_k2_profit_and_loss",
    "e_e4_e6_h7_account_lines",
    "e_j1_j2_j3_j5_cascade",
    "e_k3_k4_b32_g5_plans",
    "e_k6_e9_e10_posting_summary",
    "e_k8_d16_b20_h1_reconciliation",
    "e_j7_j8_command_verdicts",
    "e_k10_event_verdicts",
    "e_g1_review_queue",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def warm_up(spark) -> None:
    """Load classes and compile on the smallest tables, where they are at hand."""
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and small != SF_DIR.rstrip("/"):
        for name in REPORTS:
            run(catalog.QUERIES[name](spark, small))


def main() -> None:
    spark = prepare(local_session("bench", CPUS, int(CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    # The given tables are one unsplittable file each, so rows are spread before parsing.
    spark.conf.set(SPREAD, str(2 * int(CPUS)))
    warm_up(spark)
    times: dict[str, float] = {}

    def timed(name: str, step) -> None:
        started = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - started, 3)

    timed("normalize", lambda: stages.normalized_table(spark, SF_DIR))
    timed("resolve_duplicates", lambda: stages.transactions(spark, SF_DIR))
    timed("classify", lambda: derived.classified(spark, SF_DIR))
    timed("pnl_entries", lambda: report_queries._entries(spark, SF_DIR))
    for name in REPORTS:
        timed(name, lambda name=name: run(catalog.QUERIES[name](spark, SF_DIR)))
    rows = stages.normalized_table(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "end_to_end_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": SF_DIR.rstrip("/").split("sf")[-1], "raw_rows": rows, "inputs": "stored by earlier steps",
            }
        )
    )


if __name__ == "__main__":
    main()
