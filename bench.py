"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from lodetext.functions.shipping import ship
from lodetext.functions.text import PLAIN
from lodetext.operators import workload
from lodetext.plans import experiments, registry
from lodetext.plans.engine import EngineConfig, SearchEngine

NAMED = ["term_dictionary", "word_freq_top50", "bool_workload", "phrase3", "proximity_span", "rank_batch_topk", "rank_threshold_doc", "multifield_best_fields", "gap_encode", "report_left_join"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    seconds: dict[str, float] = {}
    folder = tempfile.mkdtemp(prefix="bench-")

    def timed(name, run):
        began = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(cpus) if cpus.isdigit() else 8)
    docs.write.format("noop").mode("overwrite").save()  # starts the executors
    path = f"{folder}/index"
    timed("index_build", lambda: SearchEngine.build(docs, EngineConfig(analyzer=PLAIN)).save(path))
    timed("index_build_stemmed", lambda: SearchEngine.build(docs, EngineConfig()).save(f"{folder}/stemmed"))
    engine = SearchEngine.load(spark, path)
    asked = workload.generate(workload.pools_from_vocabulary(engine.terms), 100)
    timed("workload_100_queries", lambda: engine.search(asked).write.format("noop").mode("overwrite").save())
    one_by_one = experiments.summary(experiments.timed(engine, asked[:30], warm_up=3)).first()  # mean of queries run one after the other
    seconds["single_query"] = round(one_by_one["mean"] / 1000, 3)
    known = registry.queries()
    for name in NAMED:
        timed(name, lambda name=name: known[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
