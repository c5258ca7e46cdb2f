"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from spoor.plans import catalog
from spoor.plans import registry
from spoor.session import session

HEADLINE = [
    "E01_token_entropy",
    "E03_bands",
    "E05_corpus_stats",
    "E11_semantic_entropy",
    "E14_step_boundaries",
    "H01_thresholds",
    "H02_phases",
    "H10_sweep",
    "H13_resampled_curves",
    "H16_group_comparison",
    "C08_window_means",
    "C11_all_confidences",
    "V04_threshold_search",
    "V07_majority",
    "V11_centroid_vote",
    "V17_seven_votes",
    "V22_borda",
    "J07_action_matches",
    "M01_pass_at_k",
    "M05_pass_by_difficulty",
    "M08_task_pass_hat_k",
    "M12_breakdown",
    "M22_bootstrap",
    "A07_reward_analysis",
    "A21_leaderboard",
    "D02_overlap",
    "D04_nearest",
    "X20_grading",
    "E20_repetition",
    "T06_live_phases",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in names:
        registry.forget()  # every query builds its own inputs
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
