"""Profiles of all entities at once: one exchange by entity, windows over it, and one aggregate that needs no further exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.errors import MissingColumns, ProfileError
from fleetlens.functions.columns import clipped, ratio, squashed
from fleetlens.functions.frequency import frequency_text
from fleetlens.operators import grid
from fleetlens.operators import series as series_ops
from fleetlens.operators.durable import stored

LAGS = (7, 12, 24, 30, 52, 168)
#: Rows from which an entity is spread over many tasks, and rows of a block then.
HOT_ROWS, BLOCK_ROWS = 20_000_000, 1_000_000
METRICS = ("missing_rate", "volatility", "trend_strength", "seasonality_strength", "outlier_ratio", "spike_ratio", "flatline_ratio", "sampling_irregularity", "coverage_ratio", "max_gap_seconds", "observation_density", "span_days")


def _ordered(series: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Rows with what needs their neighbours. Values are numbered among the non-null ones of their entity."""
    by_time = W.partitionBy("entity").orderBy(F.col("us").asc_nulls_last(), "tie")
    observed = W.partitionBy("entity", "absent").orderBy(F.col("us").asc_nulls_last(), "tie")
    whole = W.partitionBy("entity")
    rows = series.withColumn("absent", F.col("v").isNull()).repartition("entity")
    first = rows.withColumns({"gap": (F.col("us") - F.lag("us").over(by_time)) / 1e6, "mean": F.avg("v").over(whole), "quartiles": F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).over(whole)})
    second = first.withColumn("y", F.col("v") - F.col("mean")).withColumns(
        {"i": F.row_number().over(observed) - 1, "before": F.lag("v").over(observed), "after": F.lead("v").over(observed)} | {f"y{k}": F.lag("y", k).over(observed) for k in lags}
    )
    diff = F.col("v") - F.col("before")
    changed = F.when(F.col("before").isNull() | (F.col("before") != F.col("v")), F.col("i"))
    third = second.withColumns({"diff": diff, "run_start": F.last(changed, ignorenulls=True).over(observed.rowsBetween(W.unboundedPreceding, 0))})
    return third.withColumn("limit", F.stddev_pop("diff").over(whole))


def _metrics(series: DataFrame, sigma: float, min_run: int, lags: Sequence[int], hot_rows: int | None = None) -> DataFrame:
    """Per entity, the metrics of its rows as they are. Entities of more than hot_rows rows go another way (see split())."""
    size = int(str(series._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if hot_rows is None or size < hot_rows:  # a table of fewer bytes isn't worth the count
        return _summarised(_ordered(series, lags), sigma, min_run, lags)
    sizes = series.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("entity")  # at most rows / hot_rows of them
    hot = stored(sizes)
    if hot.isEmpty():
        return _summarised(_ordered(series, lags), sigma, min_run, lags)
    hot = F.broadcast(hot)
    usual = _summarised(_ordered(series.join(hot, "entity", "left_anti"), lags), sigma, min_run, lags)
    return usual.unionByName(_summarised(split(series.join(hot, "entity", "left_semi"), lags), sigma, min_run, lags))


def _quantiles(values: DataFrame, column: str, *shares: float) -> DataFrame:
    """entity, and an array of its exact quantiles (linear between ranks), by global ranks: no task holds an entity's values."""
    ranked = series_ops.numbered_globally(values.where(F.col(column).isNotNull()).select("entity", column), column, within=["entity"], name="r")
    sizes = ranked.groupBy("entity").agg(F.count("*").alias("n"))
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    near = ranked.join(sizes, "entity").where(reduce(lambda a, b: a | b, [F.abs(F.col("r") - 1 - at(q)) < 1 for q in shares]))
    value = lambda k: F.max(F.when(F.col("r") - 1 == k, F.col(column)))
    ends = [(value(F.floor(at(q))), value(F.ceil(at(q))), F.max(at(q) - F.floor(at(q)))) for q in shares]
    return near.groupBy("entity").agg(F.array(*[low + (high - low) * share for low, high, share in ends]).alias("quantiles"))


def split(series: DataFrame, lags: Sequence[int], block: int = BLOCK_ROWS) -> DataFrame:
    """The rows of _ordered() without any window over a whole entity: rows are numbered by ranges and cut into blocks, each with copies of the rows
    before and behind it that lags and leads reach; figures of whole entities are aggregates, joined to the rows. The gaps' median comes as
    column median_gap."""
    reach = max(lags)
    block = max(block, reach + 1)
    order = (F.col("us").asc_nulls_last(), F.col("tie"))
    rows = series.withColumn("absent", F.col("v").isNull())
    timed = series_ops.numbered_globally(rows, *order, within=["entity"], name="t")
    numbered = stored(series_ops.numbered_globally(timed, *order, within=["entity", "absent"], name="i").withColumn("i", F.col("i") - 1).withColumn("t", F.col("t") - 1))

    def blocks(df: DataFrame, index: str, before: int, behind: int) -> DataFrame:
        at, inside = F.floor(F.col(index) / block), F.col(index) % block
        homes = F.array(at, F.when(inside >= block - before, at + 1), F.when((inside < behind) & (at > 0), at - 1))
        return df.withColumn("home", at).withColumn("block", F.explode(F.array_compact(homes)))

    by_time = W.partitionBy("entity", "block").orderBy("t")
    gaps = blocks(numbered, "t", 1, 0).withColumn("gap", (F.col("us") - F.lag("us").over(by_time)) / 1e6).where("block = home").drop("block", "home")
    gapped = stored(gaps)
    whole = gapped.groupBy("entity").agg(F.avg("v").alias("mean"))
    whole = whole.join(_quantiles(gapped, "v", 0.25, 0.75).withColumnRenamed("quantiles", "quartiles"), "entity", "left").join(_quantiles(gapped, "gap", 0.5).select("entity", F.col("quantiles")[0].alias("median_gap")), "entity", "left")
    centred = gapped.join(F.broadcast(stored(whole)), "entity").withColumn("y", F.col("v") - F.col("mean"))
    observed = W.partitionBy("entity", "absent", "block").orderBy("i")
    second = blocks(centred, "i", reach, 1).withColumns({"before": F.lag("v").over(observed), "after": F.lead("v").over(observed)} | {f"y{k}": F.lag("y", k).over(observed) for k in lags})
    changed = F.when(F.col("before").isNull() | (F.col("before") != F.col("v")), F.col("i"))
    third = second.where("block = home").withColumn("diff", F.col("v") - F.col("before")).withColumn("own_start", F.last(changed, ignorenulls=True).over(observed.rowsBetween(W.unboundedPreceding, 0))).drop("home")
    kept = stored(third)
    # a run may have begun in an earlier block: the last start of the blocks before
    starts = kept.groupBy("entity", "absent", "block").agg(F.max("own_start").alias("last_start")).withColumn("carried", F.max("last_start").over(W.partitionBy("entity", "absent").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).drop("last_start")
    limits = kept.groupBy("entity").agg(F.stddev_pop("diff").alias("limit"))
    full = kept.join(starts, ["entity", "absent", "block"]).withColumn("run_start", F.coalesce("own_start", "carried"))
    return full.join(F.broadcast(limits), "entity").drop("block", "own_start", "carried")


def _irregularity() -> Column:
    return F.when(F.col("times") < 3, 0.0).when(F.col("median_gap") <= 0, 1.0).otherwise(squashed(F.try_divide(F.col("gap_sd"), F.col("median_gap"))))


def _largest_gap() -> Column:
    return F.when(F.col("times") >= 2, F.col("max_gap")).otherwise(0.0)


def _raw(series: DataFrame, sigma: float, min_run: int, lags: Sequence[int], hot_rows: int | None) -> DataFrame:
    """What a profile on a grid of given width needs of the rows: raw_sampling_irregularity, raw_max_gap_seconds, and `own`, the whole metrics of entities without a time.

    Those entities' rows are among the rows without a time, so only these are profiled."""
    size = int(str(series._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if hot_rows is not None and size >= hot_rows:  # may have entities that a window shouldn't take whole
        whole = _metrics(series, sigma, min_run, lags, hot_rows)
        return whole.select("entity", F.col("sampling_irregularity").alias("raw_sampling_irregularity"), F.col("max_gap_seconds").alias("raw_max_gap_seconds"), F.struct(*whole.columns[1:]).alias("own"))
    gap = (F.col("us") - F.lag("us").over(W.partitionBy("entity").orderBy(F.col("us").asc_nulls_last()))) / 1e6
    gaps = series.select("entity", "us").withColumn("gap", gap).groupBy("entity").agg(F.count("us").alias("times"), F.percentile("gap", 0.5).alias("median_gap"), F.stddev_pop("gap").alias("gap_sd"), F.max("gap").alias("max_gap"))
    own = _summarised(_ordered(series.where("us IS NULL"), lags), sigma, min_run, lags)
    return gaps.select("entity", _irregularity().alias("raw_sampling_irregularity"), _largest_gap().alias("raw_max_gap_seconds")).join(own.select("entity", F.struct(*own.columns[1:]).alias("own")), "entity", "left")


def _summarised(rows: DataFrame, sigma: float, min_run: int, lags: Sequence[int]) -> DataFrame:
    """The metrics from ordered rows."""
    median_gap = F.first("median_gap") if "median_gap" in rows.columns else F.percentile("gap", 0.5)
    here = ~F.col("absent")
    q1, q3 = F.col("quartiles")[0], F.col("quartiles")[1]
    outside = (F.col("v") < q1 - 1.5 * (q3 - q1)) | (F.col("v") > q3 + 1.5 * (q3 - q1))
    run = F.col("i") - F.col("run_start") + 1
    run_ends = here & (F.col("after").isNull() | (F.col("after") != F.col("v")))
    index = F.when(here, F.col("i").cast("double"))
    per = rows.groupBy("entity").agg(
        F.count("*").alias("row_count"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.min_by("v", F.when(here, F.col("i"))).alias("first"), F.covar_pop(index, "v").alias("cov"), F.var_pop(index).alias("var_i"), F.sum(F.col("y") * F.col("y")).alias("ss"),
        *[F.sum(F.col("y") * F.col(f"y{k}")).alias(f"a{k}") for k in lags],
        F.first("quartiles").alias("q"), F.count_if(here & outside).alias("outliers"), F.count("diff").alias("diffs"), F.first("limit").alias("limit"), F.count_if(F.abs("diff") > sigma * F.col("limit")).alias("spikes"),
        F.coalesce(F.sum(F.when(run_ends & (run >= min_run), run)), F.lit(0)).alias("flat"),
        F.count("us").alias("times"), F.min("us").alias("from_us"), F.max("us").alias("to_us"), median_gap.alias("median_gap"), F.stddev_pop("gap").alias("gap_sd"), F.max("gap").alias("max_gap"),
    )
    n, mean, constant = F.col("n"), F.col("mean"), F.col("low") == F.col("high")
    deviation = F.when(constant, 0.0).otherwise(F.col("sd"))
    volatility = F.when(mean == 0, clipped(deviation / (F.abs("first") + 1e-9))).otherwise(squashed(F.try_divide(deviation, F.abs(mean))))
    trend = F.when((n < 3) | constant, 0.0).otherwise(clipped(F.abs(F.coalesce(F.try_divide(F.col("cov"), F.sqrt(F.col("var_i")) * F.col("sd")), F.lit(0.0)))))
    strengths = [F.coalesce(F.abs(F.try_divide(F.col(f"a{k}"), F.col("ss"))), F.lit(0.0)) for k in lags]
    seasonality = F.when((n < 8) | constant, 0.0).otherwise(clipped(reduce(F.greatest, strengths, F.lit(0.0))))
    span = F.greatest((F.col("to_us") - F.col("from_us")) / grid.DAY, F.lit(1 / 86_400))
    two = F.col("times") >= 2
    return per.select(
        "entity", "row_count", n.alias("effective_row_count"), F.when(F.col("row_count") > 0, 1 - n / F.col("row_count")).otherwise(0.0).alias("missing_rate"),
        volatility.alias("volatility"), trend.alias("trend_strength"), seasonality.alias("seasonality_strength"),
        F.when((n < 4) | (F.col("q")[0] == F.col("q")[1]), 0.0).otherwise(ratio(F.col("outliers"), n)).alias("outlier_ratio"),
        F.when((n < 3) | ~(F.col("limit") * sigma > 0), 0.0).otherwise(ratio(F.col("spikes"), F.col("diffs"))).alias("spike_ratio"),
        F.when(n < min_run, 0.0).otherwise(ratio(F.col("flat"), n)).alias("flatline_ratio"),
        _irregularity().alias("sampling_irregularity"), F.lit(1.0).alias("coverage_ratio"),
        _largest_gap().alias("max_gap_seconds"),
        F.when(two, F.col("times") / span).otherwise(F.col("times").cast("double")).alias("observation_density"),
        F.when(two, span).otherwise(0.0).alias("span_days"),
    )


def profile(series: DataFrame, *, freq_us: int | None = None, infer: bool = False, agg: str = "mean", sigma: float = 3.0, min_run: int = 3, lags: Sequence[int] | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row for each entity: row_count, effective_row_count, METRICS, expected_freq, status (`ok`, or `all_missing`, whose metrics mean nothing).

    With freq_us or infer, metrics are of the entity's grid and so are its times; raw_sampling_irregularity and raw_max_gap_seconds then keep
    those of the rows. An entity whose frequency can't be inferred is profiled as it is. Means and last values leave empty slots out, so only slots with rows
    are made; sums fill them with 0, and make the grid. Entities of more than hot_rows rows are spread over many tasks; None says that there are none
and saves the count."""
    lags = tuple(lags or LAGS)
    if sigma <= 0 or min_run < 2 or any(k < 1 for k in lags):
        raise ValueError("sigma must be positive, min_run at least 2, and lags positive")

    def named(df: DataFrame) -> DataFrame:
        """With status; and behind a generator of one row, so that gates and rules, which mention metrics often, don't compute them each time."""
        full = df.withColumn("status", F.when(F.col("effective_row_count") > 0, "ok").otherwise("all_missing"))
        return full.select(F.explode(F.array(F.struct(*full.columns))).alias("m")).select("m.*")

    if freq_us is None and not infer:
        return named(_metrics(series, sigma, min_run, lags, hot_rows).withColumn("expected_freq", F.lit(None).cast("string")))
    if freq_us is None:
        whole = _metrics(series, sigma, min_run, lags, hot_rows)
        kept = whole.select("entity", F.col("sampling_irregularity").alias("raw_sampling_irregularity"), F.col("max_gap_seconds").alias("raw_max_gap_seconds"), F.struct(*whole.columns[1:]).alias("own"))
        wide = series.join(grid.inferred_frequency(series), "entity")
        with_freq, width = wide.where("freq_us IS NOT NULL"), F.col("freq_us")
    else:
        kept, with_freq, width = _raw(series, sigma, min_run, lags, hot_rows), series, freq_us
    slots = grid.slot_values(with_freq, width, agg)
    per_slot = grid.dense(slots, agg).select("entity", F.col("slot_us").alias("us"), "v") if agg == "sum" else slots.select("entity", (F.col("origin") + F.col("slot") * F.col("width")).alias("us"), "v")
    on_grid = _metrics(per_slot.withColumn("tie", F.struct(F.lit(0).alias("none"))), sigma, min_run, lags, hot_rows).drop("coverage_ratio", "max_gap_seconds", "observation_density", "sampling_irregularity", "span_days", "missing_rate", "row_count")
    widths = slots.groupBy("entity").agg(F.first("width").alias("width"))
    met = on_grid.join(grid.coverage(slots), "entity").join(widths, "entity")
    count = F.col("grid_slot_count")
    span = F.greatest((count - 1) * F.col("width") / grid.DAY, F.lit(1 / 86_400))
    full = met.select(
        "entity", count.alias("row_count"), "effective_row_count", (1 - F.col("effective_row_count") / count).alias("missing_rate"), *METRICS[1:7], F.lit(0.0).alias("sampling_irregularity"), "coverage_ratio",
        F.when(count >= 2, F.col("width") / 1e6).otherwise(0.0).alias("max_gap_seconds"), F.when(count >= 2, count / span).otherwise(count.cast("double")).alias("observation_density"), F.when(count >= 2, span).otherwise(0.0).alias("span_days"),
        frequency_text(F.col("width")).alias("expected_freq"),
    )
    chosen = kept.join(full.withColumn("gridded", F.lit(True)), "entity", "left")
    columns = [F.when(F.col("gridded"), F.col(c)).otherwise(F.col(f"own.{c}")).alias(c) for c in ("row_count", "effective_row_count", *METRICS)]
    return named(chosen.select("entity", *columns, "expected_freq", "raw_sampling_irregularity", "raw_max_gap_seconds"))


def of_one(df: DataFrame, time: str, value: str, **options: Any) -> dict[str, Any]:
    """The profile of one series, of a table without an entity. No rows: all figures are 0. Columns that aren't there, or no values at all: a ProfileError."""
    try:
        found = profile(series_ops.prepare(df.withColumn("__entity", F.lit(0)), "__entity", time, value), hot_rows=None, **options).first()
    except MissingColumns as error:
        raise ProfileError(str(error)) from error
    if found is None:
        return {"row_count": 0, "effective_row_count": 0} | dict.fromkeys(METRICS, 0.0)
    if found.status != "ok":
        raise ProfileError(f"none of {found.row_count} rows has a value in {value}")
    return {k: v for k, v in found.asDict().items() if k not in ("entity", "status")}


def payload() -> Column:
    """A profile row as JSON."""
    return F.to_json(F.struct("row_count", "effective_row_count", *METRICS, "expected_freq"))
