"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ("assemble_flows", "build_states", "score_stages", "build_onset_samples", "cluster_bootstrap")


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewatch.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "12g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    times, cold = {}, {}
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:  # the first run of each compiles its code; it is told as cold
        start = time.time()
        run(name)
        cold[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        run(name)
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
