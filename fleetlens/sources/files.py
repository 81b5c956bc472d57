"""Files as lazy DataFrames. validate() reads headers or footers, never data; paths may be on any file system that Spark knows."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.errors import SourceLoadError, SourceNotFound, SourceSchemaError
from fleetlens.operators.durable import exists
from fleetlens.operators.series import standard_names, to_long, with_times, without_nulls


class Source(ABC):
    """A table by name; `lazy` sources are read anew by each job, others are kept once read. `required` columns must be there, `optional` ones may."""

    def __init__(self, *, selected_columns: Sequence[str] | None = None, required: Sequence[str] = (), optional: Sequence[str] = (), lazy: bool = False):
        self.selected_columns, self.required, self.optional, self.lazy = list(selected_columns) if selected_columns else None, tuple(required), tuple(optional), lazy
        self._kept: DataFrame | None = None

    @property
    def known_columns(self) -> tuple[str, ...]:
        return self.required + self.optional

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame: ...

    def columns(self, spark: SparkSession) -> list[str]:
        return self.read(spark).columns

    def chosen(self, df: DataFrame) -> DataFrame:
        """Columns in the order they were asked for."""
        return df.select(*[F.col(f"`{c}`") for c in self.selected_columns]) if self.selected_columns else df

    def validate(self, spark: SparkSession) -> None:
        there = self.columns(spark)
        for kind, names, among in (("selected", self.selected_columns or (), there), ("required", self.required, self.selected_columns or there)):
            if gone := set(names).difference(among):
                raise SourceSchemaError(f"{kind} columns {sorted(gone)} aren't among {among}")

    def dataframe(self, spark: SparkSession) -> DataFrame:
        if self._kept is not None:
            return self._kept
        self.validate(spark)
        df = self.chosen(self.read(spark))
        if not self.lazy:
            self._kept = df.persist()
        return df

    @property
    def is_loaded(self) -> bool:
        return self._kept is not None

    def clear_cache(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None


class FileSource(Source):
    def __init__(self, path: str, **options: Any):
        super().__init__(**options)
        self.path = path

    def validate(self, spark: SparkSession) -> None:
        if not exists(spark, self.path):
            raise SourceNotFound(f"{self.path} doesn't exist")
        try:
            super().validate(spark)
        except PySparkException as error:
            raise SourceLoadError(f"{self.path}: {error}") from error


class ParquetSource(FileSource):
    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class CSVSource(FileSource):
    """A header row; types are inferred unless `types` (a DDL schema) is given. Columns in parse_dates become timestamps, null where a text is none. Columns keep the file's order."""

    def __init__(self, path: str, *, parse_dates: Sequence[str] | None = None, encoding: str = "utf-8", types: str | None = None, **options: Any):
        super().__init__(path, **options)
        self.parse_dates, self.encoding, self.types = list(parse_dates or ()), encoding, types

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("header", True).option("encoding", self.encoding)
        df = (reader.schema(self.types) if self.types else reader.option("inferSchema", True)).csv(self.path)
        for c in self.parse_dates:
            df = with_times(df, c) if c in df.columns else df
        return df

    def columns(self, spark: SparkSession) -> list[str]:
        return spark.read.option("header", True).option("encoding", self.encoding).csv(self.path).columns

    def chosen(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c in self.selected_columns]) if self.selected_columns else df


class JSONLinesSource(FileSource):
    """Lines of JSON objects of the given DDL schema; a corrupt line is null in all columns, and `_corrupt` has its text."""

    def __init__(self, path: str, types: str, **options: Any):
        super().__init__(path, **options)
        self.types = types

    def read(self, spark: SparkSession) -> DataFrame:
        parsed = F.from_json("value", f"{self.types}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        return spark.read.text(self.path).where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, timestamp, value of a CSV that has these or a mote's columns."""
    named = standard_names(CSVSource(path, parse_dates=["timestamp"], lazy=True).dataframe(spark))
    if gone := {"entity_id", "timestamp", "value"}.difference(named.columns):
        raise SourceSchemaError(f"{path} has no {sorted(gone)}")
    return named.select("entity_id", "timestamp", "value")


def load_wide_channels(spark: SparkSession, path: str, channels: Sequence[str], *, time: Sequence[str], fmt: str | None = None, sep: str = ",", null: str = "") -> DataFrame:
    """A wide CSV as a long table: channels become entities; `time` columns are joined by a space and parsed; rows without time or value are dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("nullValue", null).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    text = F.concat_ws(" ", *[F.trim(F.col(c)) for c in time])
    stamp = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    long = to_long(df.withColumn("timestamp", stamp).withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in channels}).select("timestamp", *channels), ["timestamp"], channels)
    return without_nulls(long, "timestamp", "value").select("entity_id", "timestamp", "value")


def load_mote_log(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, timestamp, value (temperature) of a white-space separated sensor log: date, time, epoch, mote, temperature, ..."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.try_to_timestamp(F.concat_ws(" ", F.get(part, F.lit(0)), F.get(part, F.lit(1)))).alias("timestamp"), F.get(part, F.lit(3)).alias("m"), F.get(part, F.lit(4)).alias("t"))
    return rows.select(F.expr("try_cast(m AS int)").alias("entity_id"), "timestamp", F.expr("try_cast(t AS double)").alias("value")).na.drop()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    """A fleet-sized report below path, wherever Spark can write: one line of JSON in `json`, a line for each figure in `text`."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")
    spark.createDataFrame([(f"{k}: {v}",) for k, v in report.items()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False
