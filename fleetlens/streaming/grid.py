"""Grid aggregates over streams: only widths that divide a day, whose slots are the same from any origin.

Late rows beyond the watermark are dropped, as Structured Streaming does; slots come out once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import finite
from fleetlens.functions.frequency import parse_frequency
from fleetlens.operators.grid import DAY


def windowed(stream: DataFrame, entity: str, time: str, value: str, frequency: str, *, lateness: str = "1 hour") -> DataFrame:
    """entity, slot_start, mean_value, rows, observed of each slot that has rows; works on static DataFrames as well."""
    width = parse_frequency(frequency)
    if DAY % width:
        raise ValueError(f"{frequency} doesn't divide a day")
    timed = stream.where(F.col(entity).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    slots = timed.groupBy(F.col(entity), F.window(time, f"{width} microseconds")).agg(F.avg(finite(F.col(value))).alias("mean_value"), F.count("*").alias("rows"), F.count(finite(F.col(value))).alias("n"))
    return slots.select(entity, F.col("window.start").alias("slot_start"), "mean_value", "rows", (F.col("n") > 0).alias("observed"))
