"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "confusion_by_set",
    "pooled_and_grouped_metrics",
    "roc_auc",
    "nearest_hamming",
    "mask_nearest",
    "connected_components",
    "z_buffer",
    "softmax_argmax",
    "morph",
    "colour_bin",
    "split_by_group",
    "dedup_content",
]


def main() -> None:
    from pixelmill.plans import REGISTRY
    from pixelmill.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = local_session(cpus, "bench")
    # one small query first, so that start-up is not charged to the first headline query
    REGISTRY["filter_category"].run(spark, sf).count()
    seconds, rows = {}, {}
    for name in names:
        t0 = time.perf_counter()
        rows[name] = len(REGISTRY[name].run(spark, sf).collect())
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": os.path.basename(sf).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
