"""Seconds of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set tables and cores.

The tables that the queries start from (market, trade days, labelled entries) are made first, since
a user has them on disk; their time is given apart. Each query runs three times and its
median counts. plain_seconds are of the same figures by pandas and NumPy in one thread (plain.py in tests).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = [
    "ladder_core", "ladder_hac", "persistence_split", "entries", "combine_rr", "rolling_percentile", "complacency", "two_axis_states", "walk_forward", "integrity_checks",
    "characteristics", "state_profile", "cond_on_off", "fan_21",
]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidelark.plans import catalogue

    t = time.time()
    world = catalogue.world(spark, sf_dir)
    for df in (world.market, world.td, world.cum_lab):
        df.count()
    made = round(time.time() - t, 3)
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(RUNS):
            t = time.time()
            catalogue.answer(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - t)
        took[name] = round(statistics.median(each), 3)
    plain = {}
    if (Path(__file__).parent / "tests" / "plain.py").exists():
        sys.path.insert(0, str(Path(__file__).parent / "tests"))
        import plain as pl

        plain = pl.seconds(world.market.toPandas(), world.td.toPandas(), RUNS)
    out = {"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir, "tables_seconds": made, "plain_seconds": plain}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
