"""Headline timings as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

The indicator table is built and written once (its own entry); the operators then
start from that table, as a survey tool starts from its data file. ``*_full`` and the
``lineitem`` entries start from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pathgram.operators import groups, predict, profile, resample, screening, sensitivity, trees  # noqa: E402
from pathgram.operators.fit import fit_by, fit_model  # noqa: E402
from pathgram.operators.metrics import flat  # noqa: E402
from pathgram.operators.moments import moment_table  # noqa: E402
from pathgram.plans.fixtures import SPEC, customer_indicators, table  # noqa: E402
from pathgram.plans.nonlinear_queries import FORM  # noqa: E402
from pathgram.session import build_session, materialise  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = sys.argv[1:]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and Python workers before the clock.
    run(spark.range(8).repartition(8).mapInArrow(lambda batches: batches, "id long"))
    times: dict[str, float] = {}

    def clock(name: str, job) -> object:
        if ONLY and name not in ONLY and name != "build_indicators":
            return None
        start = time.time()
        out = job()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return out

    fx = clock("build_indicators", lambda: materialise(customer_indicators(spark, SF_DIR), "bench"))
    columns = ["acctbal", *SPEC.indicators]
    line = table(spark, SF_DIR, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

    clock("fit_full", lambda: run(fit_model(customer_indicators(spark, SF_DIR), SPEC).metrics()))
    clock("fit", lambda: run(fit_model(fx, SPEC).metrics()))
    clock("fit_by_segment", lambda: run(fit_by(fx, SPEC, ["segment"])))

    def bootstrap(replicates: int) -> None:
        original = flat(fit_model(fx, SPEC).metrics())
        drawn = resample.bootstrap_samples(fx, SPEC, "case_id", replicates)
        drawn = drawn.select("replicate", F.concat_ws(":", "metric", "label").alias("metric"), "value")
        run(resample.bootstrap_summary(drawn, original))

    clock("bootstrap_500", lambda: bootstrap(500))
    clock("bootstrap_2000", lambda: bootstrap(2000))
    clock("bootstrap_5000", lambda: bootstrap(5000))
    pair = ("case_id", "segment", "BUILDING", "MACHINERY")
    clock("multi_group_300", lambda: run(groups.multi_group(fx, SPEC, *pair, 300)))
    clock("permutation_1000", lambda: run(groups.permutation_test(fx, SPEC, *pair, 1000)))
    clock("predict_10x10", lambda: run(predict.indicator_metrics(predict.predict_cases(fx, SPEC, "case_id", 10, 10), SPEC)))
    clock("profile", lambda: run(profile.profile(fx, columns)))
    clock("screening", lambda: [run(t) for t in screening.screen(fx, "case_id", columns).values()])
    clock("profile_lineitem", lambda: run(profile.profile(line, measures)))
    clock("moments_lineitem", lambda: run(moment_table(line.select("l_returnflag", *measures), measures, ["l_returnflag"])))
    features = ["n_orders", "n_lines", "qty", "acctbal"]
    clock("sobol_8192", lambda: run(sensitivity.sobol(fx, features, trees.formula_predictor(FORM), 13)))
    clock("trees_20", lambda: run(trees.train_trees(fx, features, "revenue", "case_id", None, {"n_estimators": 20}, 2).predictions))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
