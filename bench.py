"""Time the headline queries; prints one JSON line.

Each query runs twice on the data in $BENCH_SF_DIR and the second, warm run counts.
Results go to a sink that computes every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curvewise.plans import QUERIES  # noqa: E402
from curvewise.session import local_session  # noqa: E402

HEADLINE = [
    "v11_summary", "v05_fourtraits", "v07_deltas", "v09_critical",
    "m02_quadratic", "m08_marginal", "m13_variance", "m14_curves", "m15_predict",
    "m20_lactin", "m23_aic", "m25_local", "m26_residuals",
    "a02_se", "a05_nested", "a12_zscore", "a14_box",
    "w01_argmax", "w02_topn", "j02_pairs", "j05_predict", "t03_netrepro", "t04_slope", "t09_frame",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
