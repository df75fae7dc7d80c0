"""Headline benchmark: prints one JSON line.

Every query starts from the driver tables: shared derived tables are forgotten first.
The result is written out by the ``noop`` sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tocsin.operators import features as fe  # noqa: E402
from tocsin.operators import metrics as me  # noqa: E402
from tocsin.operators import resample as rs  # noqa: E402
from tocsin.operators.trajectory import flat_eligible  # noqa: E402
from tocsin.plans import catalog_metrics as cm  # noqa: E402
from tocsin.plans import fixtures as fx  # noqa: E402
from tocsin.plans.catalog import QUERIES  # noqa: E402


def window_features(spark, d):
    """All trailing features of five variables on the full hour grid."""
    return fe.feature_rows(fx.measurements(spark, d), fx.event_episodes(spark, d), fx.EVENTS, fx.VARIABLES, ("age",))


def all_thresholds(spark, d):
    """Trajectories, template, Youden and every threshold rule."""
    return fx.order_thresholds(spark, d)


def bootstrap_1000(spark, d):
    """1,000 stratified resamples of all methods at alpha 0.10 on the test episodes."""
    rows, names = cm.pooled_outcomes(spark, d)
    return rs.bootstrap_metrics(rows.where("alpha = 0.10"), names.where("alpha = 0.10"), ["site", "event"], 1000, fx.SEED)


def partitions_49(spark, d):
    """49 target partitions per direction, 13 strategies each."""
    _, _, out = cm.transfer_parts(spark, d, tuple(range(49)), (100, 250, 500, 1000))
    return me.summary(out, ["site", "partition", "target_m0", "method"])


def auroc_all_rows(spark, d):
    return me.threshold_free(flat_eligible(fx.order_plain(spark, d), fx.ORDERS))


BENCH = {
    "site_false_alarm": QUERIES["site_false_alarm"], "window_features": window_features,
    "all_thresholds": all_thresholds, "operating_results": QUERIES["operating_results"],
    "bootstrap_1000": bootstrap_1000, "partitions_49": partitions_49, "auroc_all_rows": auroc_all_rows,
    "record_manifest": QUERIES["exclusion_reasons"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):  # load classes and start the executor on the smallest tables
        QUERIES["site_false_alarm"](spark, warm).collect()
    times = {}
    for name, fn in BENCH.items():
        if only and name not in only.split(","):
            continue
        fx.reset()
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
