"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each runs once unmeasured, then REPEATS times; the median counts.

Beside the queries, four modes over one fleet of entities of ENTITY_ROWS rows each, made from lineitem:
stats_loop (rows and mean of each entity), profile_loop (profile, gate, recommendation), runner_stats (rows and mean by a Python function through EntityRunner on a
CSV source) and full_stack (CSV source, profile, gate, recommendation, and the fleet's entries appended to a checkpoint log).
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import checkpoint, flow, gate, profile, rules, series
from fleetlens.operators.durable import deleted, new_path
from fleetlens.operators.runner import EntityRunner
from fleetlens.plans import catalog
from fleetlens.sources import CSVSource, write_csv

REPEATS, ENTITY_ROWS = 3, 4000
NAMES = ("entity_stats", "dataset_summary", "profile_full", "profile_full_items", "profile_on_grid", "select_full", "profile_per_entity", "routing_summary", "grid_mean", "rolling_mean", "udf_entity_summary", "checkpoint_latest")
TYPES = "entity bigint, ts timestamp_ntz, value double"


def median_seconds(run) -> float:
    times = []
    for _ in range(REPEATS + 1):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 4)


def computed(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fleet(spark, sf_dir):
    """A table of entities of ENTITY_ROWS readings, a minute apart, as Parquet and as CSV; whole entities only."""
    lines = series.numbered_globally(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")
    n = lines.count() // ENTITY_ROWS * ENTITY_ROWS or ENTITY_ROWS
    at = F.col("number") - 1
    stamp = F.timestamp_add("MINUTE", at % ENTITY_ROWS, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    table = lines.where(F.col("number") <= n).select(F.floor(at / ENTITY_ROWS).alias("entity"), stamp.alias("ts"), F.col("l_quantity").cast("double").alias("value"))
    parquet, csv = new_path(spark, "fleet"), new_path(spark, "fleet-csv")
    table.write.parquet(parquet)
    write_csv(table, csv)
    return parquet, csv


def selected(table):
    return rules.selected(profile.profile(series.prepare(table, "entity", "ts", "value")), gate.EVALUATION, max_models=2).select("entity", "row_count", "gate_passed", "best_model", "coverage_ratio", "volatility")


def stats(frame, ctx):
    return {"rows": len(frame), "mean": float(frame.value.mean())}


def modes(spark, sf_dir):
    parquet, csv = fleet(spark, sf_dir)
    table = spark.read.parquet(parquet)
    source = lambda: CSVSource(csv, types=TYPES, required=["entity", "ts", "value"], lazy=True)
    own = flow.EntityFlow(stats, entity_key="entity", time_key="ts", output="struct<rows:bigint,mean:double>")

    def full_stack():
        log = checkpoint.SharedCheckpoint(spark, new_path(spark, "log"))
        done = selected(source().dataframe(spark))
        log.append_frame(done.select(F.col("entity").cast("string").alias("entity_id"), F.when(F.col("gate_passed"), "completed").otherwise("failed").alias("status")))

    seconds = {
        "stats_loop": median_seconds(lambda: computed(series.entity_stats(table, "entity", "value"))), "profile_loop": median_seconds(lambda: computed(selected(table))),
        "runner_stats": median_seconds(lambda: EntityRunner(source=source(), flow=own, batch_size=50, retries=1).run(spark)), "full_stack": median_seconds(full_stack),
    }
    rows, entities = table.count(), table.select("entity").distinct().count()
    for path in (parquet, csv):
        deleted(spark, path)
    return {"entities": entities, "rows": rows, "seconds": seconds, "entities_per_second": {k: round(entities / s, 1) for k, s in seconds.items()}, "rows_per_second": {k: round(rows / s) for k, s in seconds.items()}}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as folder:  # one machine: its disk is the shared one
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", folder).getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {name: median_seconds(lambda: computed(catalog.QUERIES[name](spark, sf_dir))) for name in NAMES}
        print(json.dumps({
            "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir), "cpus": int(cpus), "warm_up": 1, "repeats": REPEATS, "fleet": modes(spark, sf_dir),
        }))
        spark.stop()


if __name__ == "__main__":
    main()
