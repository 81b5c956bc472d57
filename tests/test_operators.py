import datetime as dt
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens import cli
from fleetlens.errors import CheckpointError, EntityFailed, GateError, MissingColumns, RetriesExhausted, SourceNotFound, SourceSchemaError
from fleetlens.functions.columns import fixed
from fleetlens.functions.frequency import format_frequency, parse_frequency
from fleetlens.operators import checkpoint, fleet, flow, gate, grid, memory, profile, retry, rules, runner, series
from fleetlens.sources import CSVSource, JSONLinesSource, ParquetSource, load_fixture, load_wide_channels, write_report

START = dt.datetime(2024, 1, 1, 5, 10)


def readings(spark, values, entity="e", hours=1.0):
    rows = [(entity, START + dt.timedelta(hours=hours * i), v, i) for i, v in enumerate(values)]
    return series.prepare(spark.createDataFrame(rows, "id string, ts timestamp_ntz, v double, n int"), "id", "ts", "v", ["n"])


def one(spark, values, **options):
    return profile.profile(readings(spark, values), **options).first()


def test_missing(spark):
    r = one(spark, [1.0, 2.0, None, 4.0])
    assert (r.row_count, r.effective_row_count, r.missing_rate, r.status) == (4, 3, 0.25, "ok")


def test_nan_is_missing(spark):
    assert one(spark, [1.0, float("nan"), 3.0]).missing_rate == pytest.approx(1 / 3)


def test_ramp_sine_constant_spike(spark):
    assert one(spark, [float(i) for i in range(50)]).trend_strength == pytest.approx(1.0)
    assert one(spark, [math.sin(i / 3) for i in range(90)]).seasonality_strength > 0.2
    flat = one(spark, [5.0] * 20)
    assert (flat.flatline_ratio, flat.volatility, flat.trend_strength, flat.seasonality_strength) == (1.0, 0.0, 0.0, 0.0)
    assert one(spark, [0.0] * 10 + [100.0] + [0.0] * 10).spike_ratio > 0


def test_short_series(spark):
    for n in (1, 2, 3, 4, 7):
        r = one(spark, [float(i % 3) for i in range(n)])
        assert all(0 <= getattr(r, m) for m in profile.METRICS)


def test_all_missing_and_empty(spark):
    assert one(spark, [None, None]).status == "all_missing"
    assert profile.profile(readings(spark, [])).count() == 0


def test_null_entities_go(spark):
    df = spark.createDataFrame([(None, START, 1.0), ("a", START, 2.0)], "id string, ts timestamp_ntz, v double")
    assert series.prepare(df, "id", "ts", "v").count() == 1
    with pytest.raises(MissingColumns):
        series.prepare(df, "id", "when", "v")


@pytest.mark.parametrize("steps", [1, 4])
def test_hot_entities_have_the_same_profile(spark, steps):
    rows = [(e, START + dt.timedelta(minutes=7 * i + i * i % 5), None if i % 11 == 3 else float((i * 7919 + len(e)) % 13 // steps), i) for e, n in (("hot", 700), ("warm", 450), ("cold", 20)) for i in range(n)]
    own = series.prepare(spark.createDataFrame(rows, "id string, ts timestamp_ntz, v double, n int"), "id", "ts", "v", ["n"])
    usual = {r.entity: r for r in profile.profile(own, hot_rows=None).collect()}
    whole = profile._summarised(profile.split(own.where("entity <> 'cold'"), profile.LAGS, 1), 3.0, 3, profile.LAGS)
    for r in [*profile.profile(own, hot_rows=100).collect(), *whole.collect()]:
        for metric in ("row_count", "effective_row_count", *profile.METRICS):
            assert getattr(r, metric) == pytest.approx(getattr(usual[r.entity], metric)), (r.entity, metric)


def test_numbers_are_global(spark):
    numbered = series.numbered_globally(spark.range(1000).withColumn("g", F.col("id") % 3), F.desc("id"), within=["g"])
    assert {(r.g, r.number) for r in numbered.collect()} == {(g, n) for g in range(3) for n in range(1, 334 + (g == 0))}
    assert numbered.where("id = 999").first().number == 1


def test_grid_starts_at_first_midnight(spark):
    slots = grid.resample(readings(spark, [1.0, 2.0, 3.0], hours=7), parse_frequency("7h")).orderBy("slot_us").collect()
    first = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=slots[0].slot_us)
    assert first == dt.datetime(2024, 1, 1) and len(slots) == 3


def test_sum_grid_fills_with_zero(spark):
    values = [r.v for r in grid.resample(readings(spark, [1.0, 2.0], hours=3), parse_frequency("1h"), "sum").orderBy("slot_us").collect()]
    assert values == [1.0, 0.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        grid.slot_values(readings(spark, [1.0]), 1, "median")


def test_frequencies():
    assert [parse_frequency(x) for x in ("1h", "90min", "31s", "1D", "h", "1h30min")] == [3600 * 10**6, 5400 * 10**6, 31 * 10**6, 86400 * 10**6, 3600 * 10**6, 5400 * 10**6]
    assert [format_frequency(x) for x in (3600 * 10**6, 86400 * 10**6, 31 * 10**6, 5400 * 10**6, 1_500_000)] == ["h", "D", "31s", "90min", "1500ms"]
    for bad in ("W", "", "1x", "0s"):
        with pytest.raises(ValueError):
            parse_frequency(bad)


def test_fixed_rounds_by_exact_value(spark):
    values = [0.0625, 0.1875, 0.0005, 0.0015, 0.0025, 2.5, 0.12345, 1.0, 0.9995]
    shown = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed(F.col("v"), 3).alias("x")).collect()]
    assert shown == [f"{v:.3f}" for v in values]


def profile_row(spark, **over):
    base = {"entity": "e", "row_count": 200, "effective_row_count": 200, "missing_rate": 0.0, "volatility": 0.3, "trend_strength": 0.1, "seasonality_strength": 0.1, "outlier_ratio": 0.0, "spike_ratio": 0.0, "flatline_ratio": 0.0, "sampling_irregularity": 0.0, "coverage_ratio": 1.0, "max_gap_seconds": 60.0, "observation_density": 1.0, "span_days": 1.0}
    return spark.createDataFrame([base | over])


def models(spark, **over):
    return rules.advised(profile_row(spark, **over), max_models=9).first()


def test_rules(spark):
    assert list(models(spark).recommended_models) == ["naive", "moving_average"]
    assert list(models(spark, coverage_ratio=0.2, effective_row_count=40).recommended_models) == ["insufficient_data"]
    sparse = models(spark, coverage_ratio=0.5, sampling_irregularity=0.4)
    assert sparse.candidates[0].priority == 8 and list(sparse.recommended_models).count("naive") == 1
    assert list(models(spark, volatility=0.6, spike_ratio=0.09).recommended_models) == ["cnn_lstm", "residual_lstm"]
    assert list(models(spark, volatility=0.5, trend_strength=0.3).recommended_models) == ["exponential_smoothing", "lstm", "gru"]
    none = models(spark, volatility=0.8)
    assert none.best_model is None and none.reason == rules.NO_MATCH
    assert models(spark, effective_row_count=0).reason == rules.NO_DATA
    assert models(spark).reason == "Stable series with weak trend and seasonality. Also consider: low volatility and few spikes suit a smoothed baseline."
    with pytest.raises(ValueError):
        rules.advised(profile_row(spark), max_models=0)


def test_gate(spark):
    r = rules.selected(profile_row(spark, effective_row_count=5, spike_ratio=0.2)).first()
    assert not r.gate_passed and list(r.gate_failures) == ["min_rows", "spike_ratio"] and r.reason == rules.GATE_FAILED and r.best_model is None
    assert [c.message for c in r.checks][0] == "effective rows 5 below minimum 30"
    assert gate.gated(profile_row(spark, missing_rate=0.25)).first().gate_passed
    for bad in ({"min_rows": 0}, {"max_missing_rate": 1.1}, {"max_gap_seconds": 0}):
        with pytest.raises(GateError):
            gate.Gate(**bad)
    assert json.loads(rules.selected(profile_row(spark)).select(rules.payload()).first()[0])["gate_passed"] is True


def test_fleet(spark):
    found = spark.createDataFrame([("naive", True, 0.9), ("lstm", True, 0.8), ("naive", False, 0.4)], "best_model string, gate_passed boolean, coverage_ratio double")
    r = fleet.routing_summary(found).first()
    assert (r.default_model, r.entities_differing_from_default, r.unique_models_assigned) == ("naive", 1, 2)
    assert r.gate_pass_rate == pytest.approx(2 / 3) and r.mean_coverage_ratio == pytest.approx(0.7)
    empty = fleet.routing_summary(found.limit(0)).first()
    assert empty.entities_profiled == 0 and empty.gate_pass_rate == 0.0
    assert fleet.usefulness(r.asDict(), {"speedup": {"4": 2.0}})["useful_on_this_dataset"]
    kpi = fleet.run_metrics(spark.createDataFrame([(10, 0.7)], "entities long, gate_pass_rate double")).first()
    assert (kpi.training_waste_avoided_rate, kpi.entities_blocked, kpi.entities_cleared) == (0.3, 3, 7)


def test_verdict_thresholds():
    total = {"mean_screening_throughput_eps": 50.0, "mean_routing_diversity_rate": 0.1, "max_unique_models_assigned": 2, "total_entities": 40, "total_entities_blocked": 5, "datasets_evaluated": 1, "portfolio_training_jobs_avoided_rate": 0.125}
    v = fleet.verdict([{"dataset": "d", "gate_pass_rate": 0.0, "entities": 3}], total, 13.6)
    assert (v["orchestration"], v["screening_throughput"], v["blocks_unfit_entities"], v["all_blocked"]) == ("pass", "partial", "pass", "d")
    assert len(fleet.highlights([{"dataset": "d", "training_jobs_avoided_rate": 0.5, "entities_blocked": 1, "entities": 2}], total)) == 4
    assert fleet.performance([{"workers": 1, "elapsed_seconds": 2, "entities_per_second": 10}, {"workers": 4, "elapsed_seconds": 1, "entities_per_second": 25}])["speedup"] == {"4": 2.5}


def sensors(spark, ids=("a", "b", "c"), n=4):
    rows = [(i, START + dt.timedelta(hours=(k * 3) % n), float(k)) for i in ids for k in range(n)]
    return spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, v double")


@flow.entity_flow(entity_key="sensor", time_key="ts")
def last_value(frame, ctx):
    assert frame.ts.is_monotonic_increasing
    return {"last": frame.v.iloc[-1], "id": ctx.entity_id}


@flow.entity_flow(entity_column="sensor", time_key="ts")
def picky(frame, ctx):
    if ctx.entity_id == "b":
        raise ValueError("no b")
    return len(frame)


def test_flow(spark):
    result = last_value.run(sensors(spark))
    assert (result.processed, result.succeeded, result.failed) == (3, 3, 0)
    assert json.loads(result.outputs().first().output)["id"] == "a"
    with pytest.raises(TypeError):
        last_value(pd.DataFrame())
    with pytest.raises(KeyError):
        last_value.flow.process_entity(sensors(spark), "zz")
    with pytest.raises(MissingColumns):
        last_value.run(sensors(spark).drop("ts"))
    with pytest.raises(ValueError):
        flow.entity_flow(entity_key="a", entity_column="b", time_key="ts")


def test_flow_failure_envelope(spark):
    bad = picky.run(sensors(spark)).by_entity("b").first()
    assert not bad.success and bad.error_type == "ValueError" and bad.error_message == "no b" and "Traceback" in bad.traceback


def test_flow_resumes(spark, tmp_path):
    own = flow.EntityFlow(picky.function, entity_key="sensor", time_key="ts", checkpoint_dir=str(tmp_path))
    assert own.run(sensors(spark)).failed == 1
    again = own.run(sensors(spark))
    assert again.processed == 1  # only the failed one


def test_runner(spark, tmp_path):
    log = checkpoint.LocalCheckpoint(str(tmp_path))
    make = lambda **o: runner.EntityRunner(source=sensors(spark), flow=picky, batch_size=2, retries=2, retry_policy=retry.RetryPolicy(initial_delay_seconds=0.01, jitter=False), **o)
    done = make(checkpoint=log).run(spark)
    assert (done.processed, done.succeeded, done.failed, done.batches, done.retries) == (3, 2, 1, 2, 1)
    again = make(checkpoint=log).run(spark)
    assert (again.processed, again.skipped) == (1, 2)
    plain = make().run(spark)
    assert plain.processed == 3 and plain.success_rate == pytest.approx(2 / 3)
    with pytest.raises(EntityFailed):
        make(fail_fast=True).run(spark)
    with pytest.raises(ValueError):
        runner.EntityRunner(source=None, flow=picky, batch_size=0)
    with pytest.raises(TypeError):
        runner.EntityRunner(source=None, flow=print)


def test_output_that_cannot_be_held_is_a_failure(spark):
    circular = []
    circular.append(circular)
    own = flow.EntityFlow(lambda frame, ctx: circular if ctx.entity_id == "b" else 1, entity_key="sensor", time_key="ts")
    assert {r.entity_id: r.success for r in own.run(sensors(spark)).envelopes.collect()} == {"a": True, "b": False, "c": True}


def test_grid_profile_of_entities_without_times(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("b", START, 2.0), ("b", None, 4.0)], "id string, ts timestamp_ntz, v double")
    found = {r.entity: r for r in profile.profile(series.prepare(df, "id", "ts", "v"), freq_us=parse_frequency("1D")).collect()}
    assert found["a"].row_count == 2 and found["a"].expected_freq is None and found["b"].row_count == 1 and found["b"].expected_freq == "D"


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from fleetlens.operators import durable

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        durable.shared_folder(Session())


def test_checkpoint_log(spark, tmp_path):
    log = checkpoint.LocalCheckpoint(str(tmp_path))
    log.mark_failed(1, error="x")
    log.mark_completed(1)
    log.mark_completed(1)
    log.mark_failed(1)
    assert log.summary()["total_entries"] == 2 and log.is_completed(1) and log.completed() == {"1"}
    with open(log.path, "a") as file:
        file.write('{"entity_id": "2", "sta')
    assert log.failed() == set()
    log.mark_completed(3)  # the cut line goes
    assert log.completed() == {"1", "3"}
    assert checkpoint.status_summary(log.dataframe(spark)).first().completed == 2
    with open(log.path, "r+") as file:
        text = file.read()
        file.seek(0)
        file.write("{broken\n" + text)
    with pytest.raises(CheckpointError):
        log.entries()
    log.clear()
    assert log.entries() == []


def test_new_entries(spark):
    old = spark.createDataFrame([(0, "a", "completed")], "seq long, entity_id string, status string")
    fresh = spark.createDataFrame([(1, "a", "failed"), (2, "b", "failed"), (3, "b", "completed"), (4, "b", "failed")], "seq long, entity_id string, status string")
    assert [r.seq for r in checkpoint.new_entries(old, fresh).orderBy("seq").collect()] == [2, 3]


def test_retry():
    policy = retry.RetryPolicy(initial_delay_seconds=0.5, max_delay_seconds=3, jitter=False)
    assert [policy.delay(k) for k in (1, 2, 3, 4, 5, 6)] == [0, 0.5, 1, 2, 3, 3]
    quick = retry.RetryPolicy(initial_delay_seconds=0, jitter=False)
    seen = []

    def flaky(attempt):
        seen.append(attempt)
        if attempt == 1:
            raise TimeoutError
        return "ok"

    assert quick.run(flaky) == ("ok", 2) and seen == [1, 2]
    with pytest.raises(RetriesExhausted) as caught:
        quick.run(lambda n: 1 / 0)
    assert caught.value.attempts == 1


def test_memory():
    with memory.MemoryScope() as scope:
        data = bytearray(30_000_000)
    assert scope.delta_mb >= 0 and data is not None
    tracker = memory.MemoryTracker()
    tracker.snapshot("a")
    assert tracker.peak_mb > 0

    @memory.track_memory
    def f():
        return 3

    assert f() == 3 and f.last_memory.after_mb > 0


def test_sources(spark, tmp_path):
    csv, parquet = str(tmp_path / "a.csv"), str(tmp_path / "a.parquet")
    with open(csv, "w") as file:
        file.write("sensor_id,timestamp,value\ns1,2024-01-01 00:00:00,1.5\ns2,nonsense,2.5\n")
    df = CSVSource(csv, parse_dates=["timestamp"]).dataframe(spark)
    assert df.schema["timestamp"].dataType.simpleString() == "timestamp" and df.where("timestamp IS NULL").count() == 1
    assert CSVSource(csv, selected_columns=["value", "sensor_id"]).dataframe(spark).columns == ["sensor_id", "value"]
    df.write.parquet(parquet)
    source = ParquetSource(parquet, selected_columns=["value", "sensor_id"])
    assert source.dataframe(spark).columns == ["value", "sensor_id"] and source.is_loaded
    source.clear_cache()
    assert not source.is_loaded
    with pytest.raises(SourceNotFound):
        CSVSource(str(tmp_path / "none.csv")).dataframe(spark)
    with pytest.raises(SourceSchemaError):
        ParquetSource(parquet, required=["missing"]).validate(spark)
    with pytest.raises(SourceSchemaError):
        ParquetSource(parquet, selected_columns=["value"], required=["sensor_id"]).validate(spark)
    with open(tmp_path / "l.jsonl", "w") as file:
        file.write('{"a": 1}\n{bad\n')
    assert JSONLinesSource(str(tmp_path / "l.jsonl"), "a int", lazy=True).dataframe(spark).where("_corrupt IS NOT NULL").count() == 1
    write_report(spark, {"k": 1}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "text")).first().value == "k: 1"


def test_open_data_loaders(spark, tmp_path):
    mote = tmp_path / "m.csv"
    mote.write_text("moteid,timestamp,temperature\n1,2024-01-01 00:00:01,20.5\n")
    assert load_fixture(spark, str(mote)).columns == ["entity_id", "timestamp", "value"]
    wide = tmp_path / "w.csv"
    wide.write_text("Date;Time;x;y\n16/12/2006;17:24:00;1.0;?\n16/12/2006;17:25:00;2.0;3.0\n")
    long = load_wide_channels(spark, str(wide), ["x", "y"], time=["Date", "Time"], fmt="dd/MM/yyyy HH:mm:ss", sep=";", null="?")
    assert sorted((r.entity_id, r.value) for r in long.collect()) == [("x", 1.0), ("x", 2.0), ("y", 3.0)]


def test_series_operators(spark):
    df = sensors(spark)
    assert [r.sensor for r in series.entities(df, "sensor").collect()] == ["a", "b", "c"]
    assert series.first_entities(df, "sensor", 2).select("sensor").distinct().count() == 2
    assert {r.sensor: r.batch for r in series.batches(df, "sensor", 2).collect()} == {"a": 0, "b": 0, "c": 1}
    assert series.head_rows(df, "sensor", 1, ["ts"]).count() == 3
    flagged = series.anomalies(spark.createDataFrame([("a", 1.0)] * 20 + [("a", 100.0)] + [("b", 5.0)], "sensor string, v double"), "sensor", "v")
    assert flagged.where("is_anomaly").count() == 1


def test_streaming_grid(spark, tmp_path):
    from fleetlens.streaming.grid import windowed

    sensors(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sensors(spark).schema).parquet(str(tmp_path / "in"))
    query = windowed(stream, "sensor", "ts", "v", "2h").writeStream.outputMode("complete").format("memory").queryName("slots").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(rows) AS n FROM slots").first().n == 12
    with pytest.raises(ValueError):
        windowed(sensors(spark), "sensor", "ts", "v", "7h")


def test_cli(spark, tmp_path, capsys):
    script = tmp_path / "p.py"
    script.write_text("def run(spark):\n    return spark.range(3).count()\n")
    assert cli.main(["run", str(script)]) == 0 and "3" in capsys.readouterr().out
    assert cli.main(["validate", str(script)]) == 0
    script.write_text("def (:\n")
    assert cli.main(["validate", str(script)]) == 1
    assert cli.main(["run", str(tmp_path / "none.py")]) == 1
    checkpoint.LocalCheckpoint(str(tmp_path / "c")).mark_completed("a")
    capsys.readouterr()
    assert cli.main(["checkpoint-status", "-c", str(tmp_path / "c"), "--show-entities"]) == 0
    assert "completed: 1" in capsys.readouterr().out
    assert cli.main(["checkpoint-status", "-c", str(tmp_path / "nothing")]) == 1
    assert cli.main(["info"]) == 0


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
