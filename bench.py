"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chainweft.plans import catalog  # noqa: E402
from chainweft.session import local_session, release  # noqa: E402

CORE = ["p1_found", "p2_found", "p4_found", "p5_found", "feature_vectors", "velocity_1h", "edge_totals", "round_trips_day", "chains_by_address", "gas_percentile", "value_stats_by_chain", "threshold_sweep", "source_findings", "nearest_vectors"]
TEXT = ["p3_found", "p6_found", "p7_found", "p8_found"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalog.QUERIES[n] for n in CORE}
    if importlib.util.find_spec("chainweft.llm"):
        queries |= {n: q for n, q in importlib.import_module("chainweft.llm.queries").QUERIES.items() if n in TEXT}
    spark.range(1000).repartition(8).mapInArrow(lambda batches: batches, "id long").agg({"id": "sum"}).collect()  # starts Python workers, too
    times = {}
    for name, query in queries.items():
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        release(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("/")[2].removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
