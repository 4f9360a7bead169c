"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line. Every query runs to completion into the no-op sink
(nothing is collected)."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main():
    from pyspark.sql import functions as F

    from densitykit.operators.dbscan import DensityClusterer
    from densitykit.operators.neighbors import eps_join
    from densitykit.operators.partition import kd_partition
    from densitykit.plans import catalog
    from densitykit.plans import fixtures as fx
    from densitykit.session import get_session

    spark = get_session(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2,
                        checkpoint_dir=tempfile.mkdtemp(prefix="densitykit-bench-", dir="/tmp"))
    sf = SF_DIR.rstrip("/")
    info = {}

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    def dbscan(name, eps=None, m=None):
        def run():
            k, e, mm = fx.FIXTURE_PARAMS[name]
            model = DensityClusterer(eps or e, m or mm).fit(fx.points(spark, sf, name))
            sink(model.result)
            info[f"rounds_{name}_{eps or e}"] = model.rounds
        return run

    def li():
        model = DensityClusterer(0.05, 20).fit(fx.li_points(spark, sf))
        sink(model.result)
        info["rounds_LI"] = model.rounds

    def pairs():
        n = eps_join(fx.pt_points(spark, sf), 2.0).count()
        info["pairs_PT"] = n

    def kd16():
        sink(kd_partition(fx.pt_points(spark, sf), max_partitions=16).points)

    def q(name):
        return lambda: sink(catalog.QUERIES[name](spark, sf))

    plan = {
        "eps_join_pt": pairs,
        "kd_partition_16": kd16,
        "dbscan_pt": dbscan("PT"),
        "dbscan_cu": dbscan("CU"),
        "dbscan_ev": dbscan("EV"),
        "dbscan_ev_giant": dbscan("EV", 8.0, 4),
        "dbscan_e3": dbscan("E3"),
        "dbscan_li": li,
        "wave_align": q("wave_align"),
        "pulse_fit": q("pulse_fit"),
        "wave_best_match": q("wave_best_match"),
        "rbf_edges": q("rbf_edges"),
    }
    only = [a for a in sys.argv[1:] if a in plan]
    times = {}
    # warm-up: JVM start and first-job costs are not part of any query
    spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count().collect()
    for name, fn in plan.items():
        if only and name not in only:
            continue
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf).replace("sf", ""), "cpus": int(CPUS), "info": info}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
