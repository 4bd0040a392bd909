"""Wall time of headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from limnos.session import build_session

HEADLINE = ("fdc", "signatures", "mann_kendall", "pettitt", "gev_lmom", "quality_outliers", "eda_stats", "alerts_report", "rpi_index", "metrics_kge",
            "lyne_hollick", "ukih", "quantile_mapping", "eto_penman_monteith", "irrigation_schedule", "spi", "rating_fit", "kendall_pairs",
            "similar_basins", "flow_accumulation", "annual_max", "join_equi", "dedupe_last", "ingest_qa", "spatial_heterogeneity")


def main() -> None:
    import limnos.plans  # noqa: F401
    from limnos.plans.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                                                        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["join_equi"](spark, sf).write.format("noop").mode("overwrite").save()  # start executors and the Python workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
