"""Headline timings: fits, scoring, explanations and the main scans over whole tables.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rulespire.catalog import QUERIES  # noqa: E402
from rulespire.config import FitConfig  # noqa: E402
from rulespire.operators.explain import explain_rows  # noqa: E402
from rulespire.plans.boost import fit_boosting  # noqa: E402
from rulespire.plans.forest import fit_forest  # noqa: E402
from rulespire.plans.grow import fit_tree  # noqa: E402
from rulespire.plans.model import score_rows  # noqa: E402
from rulespire.session import local_session  # noqa: E402
from rulespire.sources.tables import LINE_FEATURES, line_task  # noqa: E402

SCANS = [
    "bin1_quantile_edges", "hst3_joint_histogram_3d", "sea2_best_horn_pair", "sea3_best_horn_triple", "sea8_best_xor_pair",
    "spl1_stratified_runs", "tre2_node_statistics", "exp2_minimal_sets", "cal2_binned", "ana4_summary",
]


def materialize(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "rulespire-bench")
    times: dict[str, float] = {}

    def timed(name, job):
        if only and not any(name.startswith(o) for o in only):
            return None
        start = time.time()
        out = job()
        times[name] = round(time.time() - start, 3)
        return out

    line_task(spark, folder, "or2").count()  # JVM and file listing warm-up
    tree = timed("fit_or2_depth5", lambda: fit_tree(line_task(spark, folder, "or2"), "y", LINE_FEATURES, FitConfig(max_depth=5)))
    timed("fit_xor2_depth5", lambda: fit_tree(line_task(spark, folder, "xor2"), "y", LINE_FEATURES, FitConfig(max_depth=5, allow_affine=True)))
    cnf = timed("fit_cnf4_depth5", lambda: fit_tree(line_task(spark, folder, "cnf4"), "y", LINE_FEATURES, FitConfig(max_depth=5)))
    model = cnf or tree
    if model:
        timed("score_rows", lambda: materialize(score_rows(line_task(spark, folder, "cnf4"), model)))
        timed("explain_all_rows", lambda: materialize(explain_rows(line_task(spark, folder, "cnf4"), model)))
    timed("forest_20_trees", lambda: fit_forest(line_task(spark, folder, "cnf4"), "y", LINE_FEATURES, "rk", 20, 4, FitConfig(max_depth=4, n_bins=40, search_3d=False)))
    timed("boost_20_rounds", lambda: fit_boosting(line_task(spark, folder, "cnf4"), "y", LINE_FEATURES, "rk", n_rounds=20, learning_rate=0.2))
    for name in SCANS:
        timed(name, lambda: materialize(QUERIES[name](spark, folder)))
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
