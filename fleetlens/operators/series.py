"""The canonical series table, and operators on entities.

prepare() gives rows (entity, us, v, tie): the entity, microseconds since 1970, the value (NaN as null), and what breaks ties in time.
Rows without an entity are dropped, as grouping by entity does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.errors import MissingColumns
from fleetlens.functions.columns import finite, micros
from fleetlens.operators.durable import stored


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(missing, df.columns)


def entity_column_name(entity_key: str | None = None, entity_column: str | None = None) -> str:
    """Either of two names of the same parameter."""
    if entity_key and entity_column and entity_key != entity_column:
        raise ValueError(f"entity_key {entity_key!r} and entity_column {entity_column!r} differ")
    name = entity_key or entity_column
    if not name:
        raise ValueError("an entity column is needed")
    return name


def prepare(df: DataFrame, entity: str, time: str, value: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    require(df, entity, time, value, *tiebreak)
    us = micros(F.col(time), df.schema[time].dataType.simpleString())
    tie = F.struct(*[F.col(c) for c in tiebreak]) if tiebreak else F.struct(F.lit(0).alias("none"))
    return df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), us.alias("us"), finite(F.col(value)).alias("v"), tie.alias("tie"))


def entities(df: DataFrame, entity: str, *, ordered: bool = True) -> DataFrame:
    """Distinct ids, in order if asked for."""
    require(df, entity)
    out = df.select(entity).where(F.col(entity).isNotNull()).distinct()
    return out.orderBy(entity) if ordered else out


def first_entities(df: DataFrame, entity: str, most: int | None) -> DataFrame:
    """The rows of the first `most` ids; all rows for None."""
    if most is None:
        return df.where(F.col(entity).isNotNull())
    if most < 1:
        raise ValueError("max_entities must be positive")
    chosen = entities(df, entity).limit(most)
    return df.join(F.broadcast(chosen) if most <= 100_000 else chosen, entity, "left_semi")


def pending(df: DataFrame, completed: DataFrame, entity: str, *, done_entity: str = "entity_id") -> DataFrame:
    """The rows whose entity isn't completed; ids are compared as text, since logs keep them so."""
    done = completed.select(F.col(done_entity).cast("string").alias("__done")).distinct()
    return df.join(done, F.col(entity).cast("string") == F.col("__done"), "left_anti")


def skipped(df: DataFrame, completed: DataFrame, entity: str, *, done_entity: str = "entity_id") -> int:
    """How many entities of df are completed."""
    return skipped_count(df, completed, entity, done_entity=done_entity).first()[0]


def skipped_count(df: DataFrame, completed: DataFrame, entity: str, *, done_entity: str = "entity_id") -> DataFrame:
    """One row, `skipped`: the entities of df that are completed."""
    done = completed.select(F.col(done_entity).cast("string").alias("__done")).distinct()
    return entities(df, entity, ordered=False).join(done, F.col(entity).cast("string") == F.col("__done"), "left_semi").agg(F.count("*").alias("skipped"))


def group_sizes(df: DataFrame, entity: str) -> DataFrame:
    """entity, rows."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("rows"))


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """The rows that have a value, NaN being none, in each of these columns."""
    return df.na.drop(subset=list(columns))


def with_times(df: DataFrame, column: str) -> DataFrame:
    """df with the column as timestamps; null where a text is none."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column))) if df.schema[column].dataType.simpleString() == "string" else df


def batches(df: DataFrame, entity: str, size: int) -> DataFrame:
    """entity and batch (from 0) of each id, in id order. Ids are counted per range first, so no single task numbers all of them."""
    if size < 1:
        raise ValueError("batch_size must be positive")
    numbered = numbered_globally(entities(df, entity, ordered=False), entity)
    return numbered.select(entity, F.floor((F.col("number") - 1) / size).cast("long").alias("batch"))


def numbered_globally(df: DataFrame, *order: str | Column, within: Sequence[str] = (), name: str = "number") -> DataFrame:
    """df with its place (from 1) by `order`, within each combination of `within`, by whose columns `order` goes first.

    Rows are dealt by ranges, so a combination with many rows is spread over many tasks; ranges are numbered on their own, and shifted by the sizes of those before.
    The dealt rows are stored, since a range's bounds may differ when it is dealt again."""
    keys = [F.col(c) for c in within]
    spread = stored(df.repartitionByRange(*keys, *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("__part", F.spark_partition_id()))
    local = spread.withColumn("__local", F.row_number().over(W.partitionBy("__part", *within).orderBy(*order)))
    sizes = spread.groupBy(*within, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("__before", before).drop("__n")  # a row for each range and combination in it
    joined = local.join(F.broadcast(shifts), "__part") if not within else local.join(shifts, [*within, "__part"])
    return joined.withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")


def head_rows(df: DataFrame, entity: str, most: int, order: Sequence[str | Column]) -> DataFrame:
    """The first `most` rows of each entity."""
    rank = F.row_number().over(W.partitionBy(entity).orderBy(*order))
    return df.where(F.col(entity).isNotNull()).withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def entity_stats(df: DataFrame, entity: str, value: str) -> DataFrame:
    """row_count and mean_value of each entity; nulls and NaN don't count in the mean."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("row_count"), F.avg(finite(F.col(value))).alias("mean_value"))


def dataset_summary(df: DataFrame, entity: str, time: str) -> DataFrame:
    """entities, rows, least, median and most rows of an entity, and days from the first to the last time."""
    us = micros(F.col(time), df.schema[time].dataType.simpleString())
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.min(us).alias("a"), F.max(us).alias("b"))
    own = F.when(F.col(entity).isNotNull(), F.col("n"))
    return per.agg(
        F.count(own).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min(own).alias("min_rows_per_entity"), F.percentile(own, 0.5).alias("median_rows_per_entity"),
        F.max(own).alias("max_rows_per_entity"), ((F.max("b") - F.min("a")) / 86_400_000_000).alias("span_days"),
    )


def rolling_mean(df: DataFrame, entity: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """df with rolling_mean over the last `width` rows, fewer at the start."""
    return df.withColumn("rolling_mean", F.avg(value).over(W.partitionBy(entity).orderBy(*order).rowsBetween(1 - width, 0)))


def anomalies(df: DataFrame, entity: str, value: str, limit: float = 2.5) -> DataFrame:
    """df with zscore (by the sample deviation, 0 where that is 0 or undefined) and is_anomaly."""
    own = W.partitionBy(entity)
    deviation = F.stddev_samp(value).over(own)
    z = F.when(deviation > 0, F.try_divide(F.col(value) - F.avg(value).over(own), deviation)).otherwise(F.lit(0.0))
    return df.withColumn("zscore", z).withColumn("is_anomaly", F.abs("zscore") > limit)


def to_long(df: DataFrame, ids: Sequence[str], channels: Sequence[str], entity: str = "entity_id", value: str = "value") -> DataFrame:
    """Channels as entities: one row for each channel."""
    return df.unpivot(list(ids), list(channels), entity, value)


def standard_names(df: DataFrame) -> DataFrame:
    """Mote and temperature columns under the standard names."""
    return df.withColumnsRenamed({"moteid": "entity_id", "temperature": "value"})
