"""Queries that run flows, runners, logs, sources, sinks and reports on the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import warnings
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import cli, log
from fleetlens.errors import FleetError
from fleetlens.operators import checkpoint, fleet, flow, gate, legacy, memory, profile, rules
from fleetlens.operators.durable import new_path
from fleetlens.operators.retry import RetryPolicy
from fleetlens.operators.runner import EntityRunner
from fleetlens.plans import catalog
from fleetlens.plans.catalog import read, rounded
from fleetlens.sources import CSVSource, JSONLinesSource, ParquetSource, load_fixture, load_wide_channels, write_csv, write_report
from fleetlens.sources.files import load_mote_log

QUERIES: dict[str, catalog.Query] = {}


def query(f: catalog.Query) -> catalog.Query:
    QUERIES[f.__name__] = f
    return f


def error_of(call: Callable) -> str:
    """The name of the error that a call ends with."""
    try:
        call()
    except (FleetError, ValueError, TypeError, KeyError) as error:
        return type(error).__name__
    return "none"


def told(spark: SparkSession, checks: Iterable[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(name, str(found)) for name, found in checks], "case string, found string")


# Sources and sinks


def _events_csv(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "csv")
    write_csv(read(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), "event_type"), path)
    return path


@query
def csv_source(spark, sf_dir):
    source = CSVSource(_events_csv(spark, sf_dir), parse_dates=["ts"], selected_columns=["value", "user_id", "ts"], required=["user_id"], optional=["value"], lazy=True)
    return rounded(source.dataframe(spark).groupBy("user_id").agg(F.count("*").alias("rows"), F.count("value").alias("values"), F.avg("value").alias("mean_value"), F.min("ts").cast("timestamp_ntz").alias("first")), "mean_value")


@query
def json_lines_source(spark, sf_dir):
    path = new_path(spark, "lines")
    line = F.when(F.col("event_id") % 50 == 0, F.lit("{cut off")).otherwise(F.to_json(F.struct("event_id", "value")))
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    found = JSONLinesSource(path, "event_id long, value double", lazy=True).dataframe(spark)
    return found.agg(F.count("*").alias("rows"), F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"), F.sum("event_id").alias("id_sum"))


@query
def source_lifecycle(spark, sf_dir):
    source = ParquetSource(f"{sf_dir}/orders.parquet", selected_columns=["o_orderkey", "o_custkey"])
    before, rows, loaded = source.is_loaded, source.dataframe(spark).count(), source.is_loaded
    source.clear_cache()
    lazy = ParquetSource(f"{sf_dir}/orders.parquet", lazy=True)
    return told(spark, [("before", before), ("rows", rows), ("loaded", loaded), ("cleared", source.is_loaded), ("columns", ",".join(source.dataframe(spark).columns)), ("lazy", (lazy.dataframe(spark), lazy.is_loaded)[1])])


@query
def source_errors(spark, sf_dir):
    at = f"{sf_dir}/orders.parquet"
    cases = {
        "no file": ParquetSource(f"{sf_dir}/nothing.parquet"), "no selected column": ParquetSource(at, selected_columns=["o_nothing"]), "no required column": ParquetSource(at, required=["o_nothing"]),
        "required but not selected": ParquetSource(at, selected_columns=["o_orderkey"], required=["o_custkey"]), "fine": ParquetSource(at, required=["o_custkey"], optional=["o_nothing"]), "no csv": CSVSource(f"{sf_dir}/nothing.csv"),
    }
    return told(spark, [(name, error_of(lambda s=source: s.validate(spark))) for name, source in cases.items()])


@query
def fixture_source(spark, sf_dir):
    path = new_path(spark, "motes")
    write_csv(read(spark, sf_dir, "events").select(F.col("user_id").alias("moteid"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").alias("temperature")), path)
    return rounded(load_fixture(spark, path).groupBy("entity_id").agg(F.count("timestamp").alias("rows"), F.avg("value").alias("mean_value")), "mean_value")


@query
def wide_channels(spark, sf_dir):
    path = new_path(spark, "wide")
    unknown = F.lit("?")
    wide = read(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "dd/MM/yyyy").alias(" Date"), F.lit("07:30:00").alias("Time"), F.when(F.col("l_linenumber") % 3 == 0, unknown).otherwise(F.col("l_quantity").cast("double").cast("string")).alias("quantity"),
        F.when(F.col("l_orderkey") % 4 == 0, unknown).otherwise(F.col("l_tax").cast("double").cast("string")).alias("tax"),
    )
    wide.write.option("header", True).option("sep", ";").csv(path)
    long = load_wide_channels(spark, path, ["quantity", "tax"], time=["Date", "Time"], fmt="dd/MM/yyyy HH:mm:ss", sep=";", null="?")
    return rounded(long.groupBy("entity_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value"), F.min("timestamp").cast("timestamp_ntz").alias("first")), "mean_value")


@query
def mote_log(spark, sf_dir):
    path = new_path(spark, "motelog")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("event_id"), F.col("user_id"), F.when(F.col("event_id") % 9 != 0, F.col("value").cast("string")))
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return rounded(load_mote_log(spark, path).groupBy("entity_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value")), "mean_value")


@query
def report_sink(spark, sf_dir):
    path = new_path(spark, "report")
    write_report(spark, fleet.portfolio(fleet.dataset_kpis(catalog._runs(spark, sf_dir))).first().asDict(), path)
    figures = JSONLinesSource(f"{path}/json", "datasets_evaluated long, total_entities long, mean_gate_pass_rate double", lazy=True).dataframe(spark).drop("_corrupt")
    return figures.crossJoin(spark.read.text(f"{path}/text").agg(F.count("*").alias("lines")))


# Flows and runners


@flow.entity_flow(entity_column="user_id", time_key="ts", tiebreak=["event_id"], columns=["event_id", "value"])
def _last(frame: pd.DataFrame, ctx: flow.EntityContext) -> dict:
    return {"last": int(frame.event_id.iloc[-1]), "rows": len(frame), "told": f"{ctx.entity_key} {ctx.entity_id} {ctx.time_key} {ctx.attempt}"}


def _flaky(frame: pd.DataFrame, ctx: flow.EntityContext) -> int:
    if ctx.attempt <= int(ctx.entity_id) % 4:
        raise TimeoutError(f"attempt {ctx.attempt}")
    return len(frame)


def _unfit(frame: pd.DataFrame, ctx: flow.EntityContext) -> object:
    """Something that the envelope can't hold, for every fifth entity."""
    return {"no": "number"} if int(ctx.entity_id) % 5 == 0 else len(frame)


def _counts(spark: SparkSession, runs: list) -> DataFrame:
    return spark.createDataFrame([(k, r.processed, r.succeeded, r.failed) for k, r in enumerate(runs, 1)], "run long, processed long, succeeded long, failed long")


def _shared_log(spark: SparkSession) -> checkpoint.SharedCheckpoint:
    return checkpoint.SharedCheckpoint(spark, new_path(spark, "log"))


@query
def flow_decorated(spark, sf_dir):
    return _last.run(read(spark, sf_dir, "events")).outputs().select(F.col("entity_id").alias("user_id"), F.from_json("output", "last long, rows long, told string").alias("o")).select("user_id", "o.*")


@query
def flow_resume(spark, sf_dir):
    own = catalog._flow(catalog._failing, "bigint", checkpoint=_shared_log(spark))
    ev = read(spark, sf_dir, "events")
    return _counts(spark, [own.run(ev), own.run(ev)])


@query
def flow_limit(spark, sf_dir):
    return catalog._flow(catalog._failing, "bigint", max_entities=10).run(read(spark, sf_dir, "events")).envelopes.select(F.col("entity_id").alias("user_id"), "success", F.col("output").alias("rows"))


@query
def flow_unfit_output(spark, sf_dir):
    made = catalog._flow(_unfit, "bigint").envelopes(read(spark, sf_dir, "events"))
    return made.select(F.col("entity_id").alias("user_id"), "success", F.col("error_type").isNotNull().alias("told"), F.col("output").alias("rows"))


@query
def single_entity(spark, sf_dir):
    ev, own = read(spark, sf_dir, "events"), catalog._flow(catalog._summary, "struct<rows:bigint,first_event:bigint,last_event:bigint>")
    least = ev.agg(F.min("user_id")).first()[0]
    made = own.process_entity(ev, least).select(F.col("entity_id").alias("user_id"), "output.rows", "output.last_event")
    return made.withColumn("unknown", F.lit(error_of(lambda: own.process_entity(ev, -1))))


@query
def runner_csv(spark, sf_dir):
    source = CSVSource(_events_csv(spark, sf_dir), parse_dates=["ts"], required=["user_id", "ts"], lazy=True)
    done = EntityRunner(source=source, flow=_last, batch_size=60, retries=1).run(spark)
    found = F.from_json("output", "last long, rows long")
    return done.results.select(F.col("entity_id").alias("user_id"), "success", "attempts", found["rows"].alias("rows")).withColumn("batches", F.lit(done.batches).cast("long"))


@query
def runner_resume(spark, sf_dir):
    ev, kept = read(spark, sf_dir, "events"), _shared_log(spark)
    own = catalog._flow(catalog._failing, "bigint")
    runs = [EntityRunner(source=source, flow=own, checkpoint=kept, batch_size=40, retries=1, workers=n).run(spark) for source, n in ((ev.where("user_id % 3 = 0"), 1), (ev, 3))]
    return spark.createDataFrame([(k, r.processed, r.succeeded, r.failed, r.skipped, r.batches) for k, r in enumerate(runs, 1)], "run long, processed long, succeeded long, failed long, skipped long, batches long")


@query
def runner_parallel(spark, sf_dir):
    kept, said = _shared_log(spark), []
    done = EntityRunner(source=ParquetSource(f"{sf_dir}/events.parquet", selected_columns=["user_id", "ts", "event_id", "value"], lazy=True), flow=catalog._flow(catalog._failing, "bigint"), checkpoint=kept, batch_size=50, workers=3, retries=1, progress=said.append).run(spark)
    told_of = F.lit(len(said) == done.batches + 1)
    logged = checkpoint.latest_status(kept.dataframe().select("entity_id", "status", "seq")).select("entity_id", "status")
    return done.results.select(F.col("entity_id").alias("user_id"), "success", F.col("output").alias("rows")).join(logged, F.col("user_id").cast("string") == F.col("entity_id")).drop("entity_id").withColumn("told", told_of)


@query
def runner_retries(spark, sf_dir):
    own = catalog._flow(_flaky, "bigint")
    done = EntityRunner(source=read(spark, sf_dir, "events"), flow=own, retries=3, retry_policy=RetryPolicy(initial_delay_seconds=0.0, jitter=False)).run(spark)
    return done.results.select(F.col("entity_id").alias("user_id"), "success", "attempts", "error_type", "error_message").withColumn("retries", F.lit(done.retries).cast("long"))


@query
def runner_fail_fast(spark, sf_dir):
    kept = _shared_log(spark)
    own = EntityRunner(source=read(spark, sf_dir, "events"), flow=catalog._flow(catalog._failing, "bigint"), checkpoint=kept, batch_size=5, retries=1, fail_fast=True)
    try:
        own.run(spark)
        entity = None
    except FleetError as error:
        entity = error.entity
    return spark.createDataFrame([(entity, kept.dataframe().count())], "entity long, logged long")


@query
def runner_errors(spark, sf_dir):
    own = catalog._flow(catalog._failing, "bigint")
    cases = {"no flow": {"flow": print}, "no batch": {"flow": own, "batch_size": 0}, "no worker": {"flow": own, "workers": 0}, "no attempt": {"flow": own, "retries": 0}, "fine": {"flow": own}}
    made = [(name, error_of(lambda o=options: EntityRunner(source=None, **o))) for name, options in cases.items()]
    made.append(("no column", error_of(lambda: own.run(read(spark, sf_dir, "orders")))))
    made.append(("no context", error_of(lambda: _last(pd.DataFrame()))))
    made.append(("two names", error_of(lambda: flow.entity_flow(entity_key="a", entity_column="b", time_key="t"))))
    return told(spark, made)


# Older ways


@legacy.entity_processor
def _top(frame: pd.DataFrame, ctx: legacy.RunContext) -> pd.DataFrame:
    if int(ctx.entity_id) % 7 == 0:
        raise ValueError("no")
    if int(ctx.entity_id) % 7 == 1:
        return frame.event_id.max()  # no frame: a failure
    return pd.DataFrame({"user_id": [ctx.entity_id] * 2, "place": [1, 2], "event_id": [frame.event_id.max(), frame.event_id.min()]})


def _legacy(spark: SparkSession, sf_dir: str, **options) -> legacy.Flow:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        return legacy.Flow(_top, legacy.FlowConfig("user_id", retry_policy=RetryPolicy(2, 0.0, jitter=False), **options), checkpoint=_shared_log(spark))


TOP = "user_id bigint, place bigint, event_id bigint"


@query
def legacy_flow(spark, sf_dir):
    return _legacy(spark, sf_dir).run(read(spark, sf_dir, "events").select("user_id", "event_id"), TOP)[0]


@query
def legacy_flow_summary(spark, sf_dir):
    own, ev = _legacy(spark, sf_dir, max_entities=20), read(spark, sf_dir, "events").select("user_id", "event_id")
    runs = [own.run(ev, TOP)[1], own.run(ev, TOP)[1]]
    return spark.createDataFrame([(k, r.processed, r.succeeded, r.failed, r.skipped) for k, r in enumerate(runs, 1)], "run long, processed long, succeeded long, failed long, skipped long")


@query
def processor_checks(spark, sf_dir):
    class Own:
        def process(self, frame, ctx):
            return frame

    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        legacy.Flow(_top, legacy.FlowConfig("user_id"))
    defaults = legacy.FlowConfig("user_id")
    return told(spark, [
        ("marked", getattr(_top, "__entity_processor__", False)), ("plain", hasattr(_flaky, "__entity_processor__")), ("object", callable(legacy.validate_processor(Own()))), ("no processor", error_of(lambda: legacy.validate_processor(3))),
        ("warns", [w.category.__name__ for w in caught]), ("no name", error_of(lambda: legacy.FlowConfig(" "))), ("no limit", error_of(lambda: legacy.FlowConfig("e", max_entities=0))),
        ("defaults", (defaults.resume, defaults.fail_fast, defaults.retry_policy.max_attempts, defaults.max_entities)), ("context", legacy.RunContext(1, "e").elapsed_seconds() >= 0),
    ])


@query
def legacy_store(spark, sf_dir):
    store = legacy.RecordStore(_shared_log(spark))
    for record in (legacy.Record("a", False, "2024-01-01", error="x"), legacy.Record("a", True, "2024-01-02"), legacy.Record("a", False, "2024-01-03"), legacy.Record("b", False, "2024-01-04", 1.5, 3, "y")):
        store.save(record)
    rows = [(r.entity_id, r.success, r.error, r.attempts, r.completed_at if not r.success else "") for r in store.load().values()]
    store.clear()
    return spark.createDataFrame(rows, "entity_id string, success boolean, error string, attempts long, failed_at string").withColumn("left", F.lit(len(store.load())).cast("long"))


# Logs


@query
def checkpoint_marks(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # this backend's log is a file of the driver
        own = checkpoint.LocalCheckpoint(os.path.join(folder, "new"))
        own.mark_failed(1, error="x")
        own.mark_completed(1, runtime_seconds=2.0)
        own.mark_completed(1)
        own.mark_failed(1)
        own.mark_failed(2, error=ValueError("y"), attempts=3)
        kept = own.dataframe(spark)
        again = checkpoint.LocalCheckpoint(os.path.join(folder, "new"))
        found = [("entries", len(again.entries())), ("completed", sorted(again.completed())), ("failed", sorted(again.failed())), ("skips", (again.should_skip(1), again.should_skip(2))), ("file", os.path.basename(again.path))]
        found += [(f"entry {e.entity_id} {e.status}", (e.runtime_seconds, e.attempts, e.error_message, e.metadata)) for e in again.entries()]
        rows = checkpoint.status_summary(kept).first()
        again.clear()
        return told(spark, [*found, ("summary", (rows.completed, rows.failed, rows.tracked_entities, rows.total_entries)), ("cleared", len(own.entries()))])


@query
def checkpoint_log_scan(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        own = checkpoint.LocalCheckpoint(folder)
        own.append(checkpoint.Entry(str(i % 300), "completed" if i % 4 else "failed") for i in range(1000))
        with open(own.path, "a") as file:
            file.write('{"entity_id": "7", "stat')
        cut = checkpoint.latest_status(own.dataframe(spark)).select("entity_id", "status").collect()
        with open(own.path, "a") as file:
            file.write('\n{"entity_id": "8", "status": "failed"}\n')
        return spark.createDataFrame(cut, "entity_id string, status string").withColumn("corrupt", F.lit(error_of(own.entries)))


@query
def checkpoint_shared(spark, sf_dir):
    own, last = _shared_log(spark), checkpoint.latest_status(catalog._log(spark, sf_dir))
    own.append_frame(last.select("entity_id", F.lit("failed").alias("status")))
    own.append_frame(last.select("entity_id", "status"))
    own.append([checkpoint.Entry("x", "completed")])
    return own.completed_frame(spark)


@query
def checkpoint_new_entries(spark, sf_dir):
    own = catalog._log(spark, sf_dir)
    return checkpoint.new_entries(own.where("event_id % 2 = 0"), own.where("event_id % 2 = 1")).select("entity_id", "event_id", "status")


# Rules and gates over figures of every kind


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows whose metrics are drawn from part numbers, so that each rule and each check has both outcomes."""
    k = F.col("p_partkey")
    share = lambda modulus: (k % modulus) / F.lit(100.0)
    return read(spark, sf_dir, "part").select(
        k.alias("entity"), (k * 7 % 900).alias("row_count"), (k * 11 % 293 + 1).alias("effective_row_count"), share(107).alias("missing_rate"), share(89).alias("volatility"), share(83).alias("trend_strength"), share(79).alias("seasonality_strength"),
        share(41).alias("outlier_ratio"), share(31).alias("spike_ratio"), share(101).alias("flatline_ratio"), share(103).alias("sampling_irregularity"), share(97).alias("coverage_ratio"), (k * 47 % 1000).cast("double").alias("max_gap_seconds"),
        F.lit(1.0).alias("observation_density"), F.lit(1.0).alias("span_days"), F.lit(None).cast("string").alias("expected_freq"),
    )


@query
def rule_figures(spark, sf_dir):
    found = _figures(spark, sf_dir).select("entity", F.posexplode(rules.matches()).alias("place", "r"))
    return found.select("entity", "place", "r.priority", "r.model", "r.family", "r.reason", F.array_join(rules.tags_of(F.col("r.model")), ",").alias("tags"))


@query
def rule_figures_parameters(spark, sf_dir):
    found = _figures(spark, sf_dir).select("entity", F.explode(rules.matches()).alias("r"))
    return found.select("entity", "r.model", F.explode("r.parameters").alias("parameter", "value"))


@query
def recommended_figures(spark, sf_dir):
    return rules.recommended(_figures(spark, sf_dir), max_models=3)


@query
def gate_figures(spark, sf_dir):
    checks = gate.gated(_figures(spark, sf_dir), gate.Gate(min_coverage_ratio=0.5, max_gap_seconds=500.0))
    return checks.select("entity", F.explode("checks").alias("c")).select("entity", "c.name", "c.passed", "c.message", "c.threshold", "c.observed")


@query
def selection_payload(spark, sf_dir):
    out = rules.selected(_figures(spark, sf_dir), gate.Gate(max_missing_rate=0.9, max_outlier_ratio=0.9, max_spike_ratio=0.9, max_flatline_ratio=0.9))
    parsed = out.select("entity", F.from_json(rules.payload(), "gate_passed boolean, gate_failures array<string>, recommended_models array<string>, best_model string, reason string").alias("p"))
    return parsed.select("entity", "p.gate_passed", F.col("p.gate_failures").isNotNull().alias("has_failures"), F.array_join(F.coalesce("p.gate_failures", F.array().cast("array<string>")), ",").alias("failures"), F.array_join("p.recommended_models", ",").alias("models"), "p.best_model", "p.reason")


@query
def profile_payload(spark, sf_dir):
    made = rounded(profile.profile(catalog.events(spark, sf_dir)), *profile.METRICS).select("entity", F.from_json(profile.payload(), "row_count long, effective_row_count long, volatility double, span_days double").alias("p"))
    return made.select("entity", "p.*")


@query
def recommendation_payload(spark, sf_dir):
    made = rules.advised(_figures(spark, sf_dir), max_models=2).select("entity", F.from_json(rules.recommendation_payload(), "best_model string, reason string, candidates array<struct<model:string,priority:int>>").alias("p"))
    recipes = F.transform("p.candidates", lambda c: F.concat_ws(" ", c["model"], c["priority"]))
    return made.select("entity", "p.best_model", "p.reason", F.array_join(recipes, ",").alias("recipes"))


@query
def single_series(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    least = ev.where(F.col("user_id") == ev.agg(F.min("user_id")).first()[0])
    found = profile.of_one(least, "ts", "value")
    return told(spark, [
        ("rows", found["row_count"]), ("volatility", f"{found['volatility']:.4f}"), ("empty", sum(v for v in profile.of_one(ev.limit(0), "ts", "value").values() if v)), ("no column", error_of(lambda: profile.of_one(ev, "ts", "nothing"))),
        ("no values", error_of(lambda: profile.of_one(least.withColumn("value", F.lit(None).cast("double")), "ts", "value"))), ("bad sigma", error_of(lambda: profile.of_one(least, "ts", "value", sigma=0.0))),
    ])


# Reports: driver arithmetic on fleet-sized results


@query
def performance_summary(spark, sf_dir):
    rows = catalog._runs(spark, sf_dir).orderBy("dataset", "entities_per_second").limit(3).collect()
    made = fleet.performance([{"workers": 2**k, "elapsed_seconds": r.elapsed_seconds, "entities_per_second": r.entities_per_second} for k, r in enumerate(rows)])
    return spark.createDataFrame([(r["workers"], r["entities_per_second"], made["speedup"].get(str(r["workers"]), 1.0)) for r in made["runs"]], "workers long, entities_per_second double, speedup double")


@query
def usefulness(spark, sf_dir):
    routing = catalog.QUERIES["routing_summary"](spark, sf_dir).first().asDict()
    made = [(k, fleet.usefulness(routing, {"speedup": {"4": s}})) for k, s in ((1, 1.2), (2, 2.0))]
    return spark.createDataFrame([(k, u["useful_on_this_dataset"], len(u["signals"]), len(u["gaps"])) for k, u in made], "run long, useful boolean, signals long, gaps long")


@query
def report_highlights(spark, sf_dir):
    kpis = fleet.dataset_kpis(catalog._runs(spark, sf_dir))
    said = fleet.highlights([r.asDict() for r in kpis.orderBy("dataset").collect()], fleet.portfolio(kpis).first().asDict())
    return spark.createDataFrame([(k, x) for k, x in enumerate(said[3:])] or [(-1, "none")], "place long, sentence string").withColumn("before", F.lit(3).cast("long"))


@query
def report_verdict(spark, sf_dir):
    kpis = fleet.dataset_kpis(catalog._runs(spark, sf_dir))
    slow = kpis.agg(F.avg(F.col("plain_loop_throughput_eps") / F.col("screening_throughput_eps"))).first()[0]
    made = fleet.verdict([r.asDict() for r in kpis.orderBy("dataset").collect()], fleet.portfolio(kpis).first().asDict(), slow)
    return spark.createDataFrame(list(made.items()), "criterion string, status string")


# Command line and helpers


@query
def cli_checks(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()) as err:
        def script(name: str, text: str) -> str:
            path = os.path.join(folder, name)
            with open(path, "w") as file:
                file.write(text)
            return path

        run, main = script("run.py", "def run(spark):\n    return spark.range(3).count()\n"), script("main.py", "def main():\n    return 5\n")
        checkpoint.LocalCheckpoint(os.path.join(folder, "log")).mark_completed("a")
        codes = [(name, cli.main(args)) for name, args in (
            ("run", ["run", run]), ("run main", ["run", main]), ("validate", ["validate", run]), ("no entry point", ["validate", script("none.py", "x = 1\n")]), ("broken", ["validate", script("broken.py", "def (\n")]), ("no script", ["run", os.path.join(folder, "nothing.py")]),
            ("status", ["checkpoint-status", "-c", os.path.join(folder, "log"), "--show-entities"]), ("no log", ["checkpoint-status", "-c", os.path.join(folder, "nothing")]), ("info", ["info"]),
        )]
        said = [(word, word in out.getvalue() or word in err.getvalue()) for word in ("completed: 1", "hint: define one of", "entry point run")]
    return told(spark, [*codes, *said])


@query
def helper_checks(spark, sf_dir):
    @memory.track_memory
    def three():
        return 3

    tracker = memory.MemoryTracker()
    tracker.snapshot("a")
    with memory.MemoryScope() as scope:
        data = bytearray(1_000_000)
    own = log.setup_logging("WARNING")
    return told(spark, [
        ("tracked", three()), ("measured", three.last_memory.after_mb > 0), ("delta", scope.delta_mb >= 0 and len(data) > 0), ("peak", tracker.peak_mb > 0), ("snapshots", len(tracker.snapshots)), ("logger", log.get_logger("x").name), ("level", own.level),
        ("handlers", len(log.setup_logging("WARNING").handlers)),
    ])
