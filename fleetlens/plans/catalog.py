"""Queries over the test tables, by name; each takes (spark, sf_dir). Computed numbers are rounded to six digits so that engines agree."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.columns import from_micros
from fleetlens.functions.frequency import frequency_text, parse_frequency
from fleetlens.operators import checkpoint, fleet, flow, gate, grid, profile, retry, rules, series
from fleetlens.streaming.grid import windowed

#: The metrics that queries round and show.
SHOWN = profile.METRICS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.prepare(read(spark, sf_dir, "events"), "user_id", "ts", "value", ["event_id"])


def items(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> DataFrame:
    return series.prepare(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", value, ["l_orderkey", "l_linenumber"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.prepare(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", ["o_orderkey"])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def shown(profiles: DataFrame, *metrics: str) -> DataFrame:
    return rounded(profiles.select("entity", "row_count", "effective_row_count", *metrics), *metrics)


# Entities


@query
def entity_list(spark, sf_dir):
    return series.entities(read(spark, sf_dir, "events"), "user_id", ordered=False)


@query
def entity_limit(spark, sf_dir):
    return series.first_entities(read(spark, sf_dir, "events"), "user_id", 25).select("event_id", "user_id", "value")


@query
def skip_completed_anti(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    done = ev.where("event_type = 'purchase'").groupBy("user_id").count().where("count >= 15").select("user_id")
    return series.pending(series.entities(ev, "user_id", ordered=False), done, "user_id", done_entity="user_id")


@query
def skipped_count(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    done = ev.where("event_type = 'purchase'").select("user_id").distinct()
    return series.skipped_count(ev, done, "user_id", done_entity="user_id")


@query
def batch_assignment(spark, sf_dir):
    return series.batches(read(spark, sf_dir, "orders"), "o_custkey", 100)


@query
def entity_stats(spark, sf_dir):
    return rounded(series.entity_stats(read(spark, sf_dir, "events"), "user_id", "value"), "mean_value")


@query
def dataset_summary(spark, sf_dir):
    return rounded(series.dataset_summary(read(spark, sf_dir, "events"), "user_id", "ts"), "median_rows_per_entity", "span_days")


@query
def head_rows_per_entity(spark, sf_dir):
    return series.head_rows(read(spark, sf_dir, "events"), "user_id", 5, ["ts", "event_id"]).select("user_id", "event_id", "value")


@query
def group_sizes(spark, sf_dir):
    return series.group_sizes(read(spark, sf_dir, "lineitem"), "l_suppkey")


# Scans and projections


@query
def source_projection(spark, sf_dir):
    from fleetlens.sources import ParquetSource

    source = ParquetSource(f"{sf_dir}/orders.parquet", selected_columns=["o_orderkey", "o_custkey", "o_totalprice"], required=["o_custkey"], lazy=True)
    return source.dataframe(spark).where("o_totalprice > 100000")


@query
def coerced_times(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return series.with_times(read(spark, sf_dir, "events").select("event_id", text.alias("time")), "time").select("event_id", F.col("time").isNotNull().alias("is_time"))


@query
def null_rows_dropped(spark, sf_dir):
    return series.without_nulls(read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value")), "value")


@query
def unpivot_long(spark, sf_dir):
    wide = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return series.to_long(wide.withColumns({c: F.col(c).cast("double") for c in wide.columns[2:]}), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"])


@query
def standard_names(spark, sf_dir):
    return series.standard_names(read(spark, sf_dir, "events").select(F.col("user_id").alias("moteid"), F.col("value").alias("temperature"), "event_id"))


@query
def rolling_mean(spark, sf_dir):
    return rounded(series.rolling_mean(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "rolling_mean"), "rolling_mean")


@query
def zscore_anomaly(spark, sf_dir):
    return rounded(series.anomalies(read(spark, sf_dir, "events"), "user_id", "value").select("event_id", "zscore", "is_anomaly"), "zscore")


# Grids


def _grid(spark, sf_dir, frequency: str, agg: str) -> DataFrame:
    out = grid.resample(events(spark, sf_dir), parse_frequency(frequency), agg)
    return rounded(out.select("entity", from_micros(F.col("slot_us"), "timestamp_ntz").alias("slot_start"), "v", "was_observed"), "v")


@query
def grid_mean(spark, sf_dir):
    return _grid(spark, sf_dir, "1D", "mean")


@query
def grid_sum(spark, sf_dir):
    return _grid(spark, sf_dir, "12h", "sum")


@query
def grid_last(spark, sf_dir):
    return _grid(spark, sf_dir, "6h", "last")


@query
def grid_non_divisor_freq(spark, sf_dir):
    return _grid(spark, sf_dir, "7h", "mean")


@query
def grid_coverage(spark, sf_dir):
    return rounded(grid.coverage(grid.slot_values(events(spark, sf_dir), parse_frequency("7h"))), "coverage_ratio")


@query
def infer_freq(spark, sf_dir):
    return grid.inferred_frequency(events(spark, sf_dir)).withColumn("freq", frequency_text(F.col("freq_us")))


@query
def calendar_metrics(spark, sf_dir):
    return rounded(grid.calendar_metrics(orders(spark, sf_dir)), "span_days", "max_gap_seconds", "observation_density")


@query
def resample_2h(spark, sf_dir):
    return rounded(windowed(read(spark, sf_dir, "events"), "user_id", "ts", "value", "2h").select("user_id", F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), "mean_value"), "mean_value")


@query
def stream_grid(spark, sf_dir):
    return rounded(windowed(read(spark, sf_dir, "events"), "user_id", "ts", "value", "6h").withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz")), "mean_value")


# Profiles


def _metric(name: str, *metrics: str, source=items) -> None:
    def run(spark, sf_dir):
        return shown(profile.profile(source(spark, sf_dir)), *metrics)

    QUERIES[name] = run


_metric("profile_volatility", "volatility", source=events)
_metric("profile_trend", "trend_strength", source=events)
_metric("profile_seasonality", "seasonality_strength", source=events)
_metric("profile_outlier", "outlier_ratio", source=events)
_metric("profile_spike", "spike_ratio")
_metric("profile_flatline", "flatline_ratio")
_metric("profile_irregularity", "sampling_irregularity", source=orders)
_metric("profile_missing", "missing_rate", source=lambda spark, sf_dir: _with_nulls(spark, sf_dir))
_metric("profile_calendar", "max_gap_seconds", "observation_density", "span_days", source=events)
_metric("profile_full", *SHOWN, source=events)
_metric("profile_full_items", *SHOWN)
_metric("profile_full_orders", *SHOWN, source=orders)


def _with_nulls(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("v", F.when(F.col("tie.event_id") % 3 != 0, F.col("v")))


@query
def profile_with_nulls(spark, sf_dir):
    return shown(profile.profile(_with_nulls(spark, sf_dir)), *SHOWN)


@query
def profile_on_grid(spark, sf_dir):
    return shown(profile.profile(events(spark, sf_dir), freq_us=parse_frequency("1D")), *SHOWN)


@query
def profile_on_sum_grid(spark, sf_dir):
    return shown(profile.profile(events(spark, sf_dir), freq_us=parse_frequency("1D"), agg="sum"), *SHOWN)


@query
def profile_inferred_grid(spark, sf_dir):
    return shown(profile.profile(events(spark, sf_dir), infer=True).withColumn("row_count", F.col("row_count")), "missing_rate", "coverage_ratio", "volatility", "raw_sampling_irregularity", "raw_max_gap_seconds")


# Gates, rules, selections. Thresholds see metrics rounded to six digits, in both engines.


def _profiles(spark, sf_dir) -> DataFrame:
    return rounded(profile.profile(events(spark, sf_dir)), *SHOWN)


def _daily(spark, sf_dir) -> DataFrame:
    return rounded(profile.profile(events(spark, sf_dir), freq_us=parse_frequency("1D")), *SHOWN)


def _select(profiles: DataFrame, quality: gate.Gate | None = None, most: int = 3) -> DataFrame:
    return rules.selected(profiles, quality, max_models=most)


@query
def gate_checks(spark, sf_dir):
    checks = gate.gated(_profiles(spark, sf_dir), gate.Gate(min_coverage_ratio=0.5, max_gap_seconds=200_000.0))
    return checks.select("entity", F.explode("checks").alias("c")).select("entity", "c.name", "c.passed", "c.message", "c.threshold", "c.observed")


@query
def gate_failures(spark, sf_dir):
    return gate.gated(_profiles(spark, sf_dir)).select("entity", "gate_passed", F.array_join("gate_failures", ",").alias("failures"))


@query
def gate_evaluation_preset(spark, sf_dir):
    found = gate.gated(rounded(profile.profile(items(spark, sf_dir)), *SHOWN), gate.EVALUATION)
    return found.select("entity", "gate_passed", F.array_join("gate_failures", ",").alias("failures"))


@query
def rule_matches(spark, sf_dir):
    found = _profiles(spark, sf_dir).select("entity", F.posexplode(rules.matches()).alias("place", "r"))
    return found.select("entity", "place", "r.priority", "r.model", "r.family", "r.reason", F.array_join("r.tags", ",").alias("tags"))


@query
def rule_parameters(spark, sf_dir):
    found = _daily(spark, sf_dir).select("entity", F.explode(rules.matches()).alias("r"))
    return found.select("entity", "r.model", F.explode("r.parameters").alias("parameter", "value"))


@query
def recommend_topk(spark, sf_dir):
    return rules.advised(_daily(spark, sf_dir), max_models=2).select("entity", F.array_join("recommended_models", ",").alias("models"), "best_model")


@query
def select_full(spark, sf_dir):
    return _select(_profiles(spark, sf_dir)).select("entity", "gate_passed", F.array_join("gate_failures", ",").alias("failures"), F.array_join("recommended_models", ",").alias("models"), "best_model", "reason")


@query
def select_daily_grid(spark, sf_dir):
    return _select(_daily(spark, sf_dir), gate.Gate(min_rows=10, max_missing_rate=0.6)).select("entity", "gate_passed", F.array_join("recommended_models", ",").alias("models"), "best_model", "reason")


@query
def summary_reason(spark, sf_dir):
    return rules.advised(_daily(spark, sf_dir)).select("entity", "reason", F.array_join(F.map_keys("reasons"), ",").alias("with_reasons"))


@query
def profile_per_entity(spark, sf_dir):
    """The per-entity record of fleet evaluations: at most two models, evaluation gate."""
    out = _select(rounded(profile.profile(items(spark, sf_dir)), *SHOWN), gate.EVALUATION, most=2)
    return out.select("entity", F.col("row_count").alias("rows"), "gate_passed", "best_model", F.round("coverage_ratio", 4).alias("coverage_ratio"), F.round("volatility", 4).alias("volatility"))


# Fleet


@query
def model_distribution(spark, sf_dir):
    return fleet.model_distribution(_select(_profiles(spark, sf_dir)))


@query
def routing_summary(spark, sf_dir):
    return rounded(fleet.routing_summary(_select(_profiles(spark, sf_dir))), "gate_pass_rate", "routing_diversity_rate", "mean_coverage_ratio")


def _runs(spark, sf_dir) -> DataFrame:
    """Runs of three datasets (event types) in three modes, with figures drawn from the table."""
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count_distinct("user_id").alias("entities"), F.count("*").alias("rows"), F.round(F.avg("value"), 2).alias("v"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(s).alias("speed")) for m, s in (("plain_loop", 8.0), ("profile_loop", 2.0), ("full_stack", 1.0))])).alias("m")
    runs = per.select("*", modes).select("dataset", "m.mode", "entities", "rows", "v", "m.speed")
    return runs.select(
        "dataset", "mode", "entities", "rows", F.lit(12.34).alias("span_days"), (F.col("entities") / (F.col("speed") * 10)).alias("elapsed_seconds"), (F.col("speed") * 10).alias("entities_per_second"),
        F.round(F.col("rows") % 10 / 10, 1).alias("gate_pass_rate"), F.round(F.col("rows") % 7 / 20, 2).alias("routing_diversity_rate"), (F.col("rows") % 4 + 1).alias("unique_models"), F.lit(0.5).alias("mean_coverage_ratio"),
    )


@query
def kpi_datasets(spark, sf_dir):
    return rounded(fleet.dataset_kpis(_runs(spark, sf_dir)), "gate_pass_rate", "training_jobs_avoided_rate", "orchestration_overhead_seconds", "profiling_cost_factor")


@query
def kpi_portfolio(spark, sf_dir):
    return fleet.portfolio(fleet.dataset_kpis(_runs(spark, sf_dir)))


@query
def kpi_normalised(spark, sf_dir):
    return rounded(fleet.normalised(fleet.dataset_kpis(_runs(spark, sf_dir)), "entities").select("dataset", "entities_share"), "entities_share")


@query
def run_metrics(spark, sf_dir):
    return rounded(fleet.run_metrics(_runs(spark, sf_dir)).select("dataset", "mode", "training_waste_avoided_rate", "entities_blocked", "entities_cleared"), "training_waste_avoided_rate")


# Flows


def _summary(frame: pd.DataFrame, ctx: flow.EntityContext) -> dict:
    return {"rows": len(frame), "first_event": int(frame.event_id.iloc[0]), "last_event": int(frame.event_id.iloc[-1])}


def _failing(frame: pd.DataFrame, ctx: flow.EntityContext) -> int:
    if int(ctx.entity_id) % 7 == 0:
        raise ValueError(f"no luck with {ctx.entity_id}")
    return len(frame)


def _flow(function: Callable, output: str = "string", **options) -> flow.EntityFlow:
    return flow.EntityFlow(function, entity_key="user_id", time_key="ts", tiebreak=["event_id"], columns=["event_id", "value"], output=output, **options)


@query
def udf_entity_summary(spark, sf_dir):
    made = _flow(_summary, "struct<rows:bigint,first_event:bigint,last_event:bigint>").envelopes(read(spark, sf_dir, "events"))
    return made.select(F.col("entity_id").alias("user_id"), "success", "output.rows", "output.first_event", "output.last_event")


@query
def udf_failure_envelope(spark, sf_dir):
    made = _flow(_failing, "bigint").envelopes(read(spark, sf_dir, "events"))
    return made.select(F.col("entity_id").alias("user_id"), "success", "attempts", "error_type", "error_message", F.col("output").alias("rows"))


@query
def run_summary(spark, sf_dir):
    return fleet.run_summary(_flow(_failing, "bigint").envelopes(read(spark, sf_dir, "events"))).select("processed", "succeeded", "failed", "retries", F.round("success_rate", 6).alias("success_rate"))


# Checkpoints: the events as a log


def _log(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type").isin("purchase", "view"), "completed").otherwise("failed")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), status.alias("status"), F.struct("ts", "event_id").alias("seq"), "event_id")


@query
def checkpoint_latest(spark, sf_dir):
    return checkpoint.latest_status(_log(spark, sf_dir)).select("entity_id", "status", "event_id")


@query
def checkpoint_completed(spark, sf_dir):
    return checkpoint.latest_status(_log(spark, sf_dir)).where("status = 'completed'").select("entity_id")


@query
def checkpoint_summary(spark, sf_dir):
    return checkpoint.status_summary(_log(spark, sf_dir))


@query
def retry_delays(spark, sf_dir):
    """Waiting times before attempts 1 to 10, by the default policy without jitter."""
    policy = retry.RetryPolicy(jitter=False)
    return spark.createDataFrame([(k, policy.delay(k)) for k in range(1, 11)], "attempt long, seconds double")
