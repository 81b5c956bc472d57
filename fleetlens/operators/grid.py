"""Regular time grids. A slot is counted from the midnight (UTC) of an entity's first day, so slots need no common origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000
AGGREGATES = ("mean", "sum", "last")


def inferred_frequency(series: DataFrame) -> DataFrame:
    """entity, freq_us: the median gap, whole microseconds; null for under two times or a median of 0."""
    gap = F.col("us") - F.lag("us").over(W.partitionBy("entity").orderBy("us"))
    gaps = series.where("us IS NOT NULL").select("entity", gap.alias("gap"))
    median = F.floor(F.percentile("gap", 0.5)).cast("long")
    return gaps.groupBy("entity").agg(median.alias("m")).select("entity", F.when(F.col("m") > 0, F.col("m")).alias("freq_us"))


def slotted(series: DataFrame, freq_us: int | Column) -> DataFrame:
    """series with origin and slot; rows without a time are dropped. freq_us: a number, or a column of series."""
    width = F.lit(freq_us).cast("long") if isinstance(freq_us, int) else freq_us
    timed = series.where("us IS NOT NULL")
    # an aggregate and a join, which split an entity of many rows, in place of a window, which doesn't
    origins = timed.groupBy("entity").agg((F.floor(F.min("us") / DAY) * DAY).cast("long").alias("origin"))
    return timed.join(origins, "entity").withColumn("width", width).withColumn("slot", F.floor((F.col("us") - F.col("origin")) / F.col("width")).cast("long"))


def slot_values(series: DataFrame, freq_us: int | Column, agg: str = "mean") -> DataFrame:
    """entity, origin, width, slot, v, observed of each slot that has rows; v by `agg` over non-null values."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    # sum of nothing is 0, not null
    value = {"mean": F.avg("v"), "sum": F.coalesce(F.sum("v"), F.lit(0.0)), "last": F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("us", "tie")))}[agg]
    return slotted(series, freq_us).groupBy("entity", "origin", "width", "slot").agg(value.alias("v"), (F.count("v") > 0).alias("observed"))


def coverage(slots: DataFrame) -> DataFrame:
    """entity, grid_slot_count, observed_slot_count, coverage_ratio; no slot is made for that."""
    n = F.max("slot") - F.min("slot") + 1
    return slots.groupBy("entity").agg(n.alias("grid_slot_count"), F.count_if("observed").alias("observed_slot_count")).withColumn("coverage_ratio", F.col("observed_slot_count") / F.col("grid_slot_count"))


def dense(slots: DataFrame, agg: str = "mean") -> DataFrame:
    """entity, slot_us, v, was_observed of every slot from the first to the last; empty slots have null, or 0 for sums.

    Gaps are filled in place, each row making the empty slots behind it, so the grid takes no join."""
    after = F.lead("slot").over(W.partitionBy("entity").orderBy("slot"))
    gaps = slots.withColumn("last", F.coalesce(after - 1, F.col("slot")))
    every = gaps.select("entity", "origin", "width", F.col("slot").alias("own"), "v", "observed", F.explode(F.sequence("slot", "last")).alias("slot"))
    empty = F.lit(0.0) if agg == "sum" else F.lit(None).cast("double")
    here = F.col("slot") == F.col("own")
    return every.select("entity", (F.col("origin") + F.col("slot") * F.col("width")).alias("slot_us"), F.when(here, F.col("v")).otherwise(empty).alias("v"), (here & F.col("observed")).alias("was_observed"))


def resample(series: DataFrame, freq_us: int | Column, agg: str = "mean") -> DataFrame:
    """The whole grid of each entity, with was_observed."""
    return dense(slot_values(series, freq_us, agg), agg)


def calendar_metrics(series: DataFrame) -> DataFrame:
    """entity, span_days, max_gap_seconds, observation_density of the times."""
    gap = F.col("us") - F.lag("us").over(W.partitionBy("entity").orderBy("us"))
    per = series.select("entity", "us", gap.alias("gap")).groupBy("entity").agg(F.count("us").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.max("gap").alias("gap"))
    span = F.greatest((F.col("b") - F.col("a")) / DAY, F.lit(1 / 86_400))
    two = F.col("n") >= 2
    return per.select("entity", F.when(two, span).otherwise(0.0).alias("span_days"), F.when(two, F.col("gap") / 1e6).otherwise(0.0).alias("max_gap_seconds"), F.when(two, F.col("n") / span).otherwise(F.col("n").cast("double")).alias("observation_density"))
