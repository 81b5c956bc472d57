"""User functions per entity, as grouped-map Arrow functions with a fixed envelope.

Filters, limits and resume happen before grouping, as Spark can't push them below it. One entity's rows have to fit a Python worker. Spark may run a function again
after losing an executor, so functions must be idempotent.
"""

from __future__ import annotations

import json
import logging
import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from fleetlens.errors import RetriesExhausted
from fleetlens.operators import series
from fleetlens.operators.checkpoint import COMPLETED, FAILED, CheckpointBackend, LocalCheckpoint
from fleetlens.operators.durable import stored
from fleetlens.operators.memory import MemoryScope
from fleetlens.operators.retry import RetryPolicy

#: Fixed columns of an envelope behind entity_id and before output.
STATUS = "success boolean, runtime_seconds double, memory_delta_mb double, attempts int, error_type string, error_message string, traceback string"


@dataclass(frozen=True)
class EntityContext:
    entity_id: Any
    entity_key: str
    time_key: str | None
    attempt: int = 1
    started_at: float = field(default_factory=time.time)
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def logger(self) -> logging.Logger:
        return logging.getLogger(f"fleetlens.entity.{self.entity_id}")

    def elapsed_seconds(self) -> float:
        return time.time() - self.started_at


@dataclass
class RunSummary:
    processed: int = 0
    succeeded: int = 0
    failed: int = 0
    skipped: int = 0
    batches: int = 0
    retries: int = 0
    runtime_seconds: float = 0.0
    peak_memory_mb: float = 0.0
    results: DataFrame | None = None

    @property
    def success_rate(self) -> float:
        return self.succeeded / self.processed if self.processed else 0.0

    def counted(self, envelopes: DataFrame) -> RunSummary:
        """Takes the counts of envelopes."""
        r = envelopes.agg(F.count("*"), F.count_if("success"), F.sum(F.col("attempts") - 1), F.max("memory_delta_mb")).first()
        self.processed, self.succeeded, self.failed, self.retries, self.peak_memory_mb, self.results = r[0], r[1], r[0] - r[1], r[2] or 0, r[3] or 0.0, envelopes
        return self

    def text(self) -> str:
        return f"{self.processed} processed, {self.succeeded} succeeded, {self.failed} failed, {self.skipped} skipped, {self.retries} retries in {self.batches} batches, {self.runtime_seconds:.1f} s"


def jsonable(value: Any) -> str:
    return json.dumps(value, default=lambda x: x.item() if hasattr(x, "item") else x.to_dict() if hasattr(x, "to_dict") else str(x))


class EntityFlow:
    """A function (frame, context) -> anything, applied to each entity's rows in time order."""

    def __init__(self, function: Callable, *, entity_key: str, time_key: str | None, output: str = "string", columns: Sequence[str] | None = None, tiebreak: Sequence[str] = (), sort_entities: bool = True, max_entities: int | None = None, checkpoint: CheckpointBackend | None = None, checkpoint_dir: str | None = None, resume: bool = True, retry: RetryPolicy | None = None):
        if not callable(function):
            raise TypeError("an entity flow needs a function (frame, context)")
        self.function, self.entity_key, self.time_key, self.output, self.columns, self.tiebreak = function, entity_key, time_key, output, columns, tuple(tiebreak)
        self.sort_entities, self.max_entities, self.resume = sort_entities, max_entities, resume
        self.checkpoint = checkpoint or (LocalCheckpoint(checkpoint_dir) if checkpoint_dir else None)
        self.retry = retry or RetryPolicy(max_attempts=1)

    def validate(self, df: DataFrame) -> None:
        series.require(df, self.entity_key, *([self.time_key] if self.time_key else []), *self.tiebreak)

    def envelopes(self, df: DataFrame) -> DataFrame:
        """entity_id, STATUS, output of every entity of df; lazy."""
        self.validate(df)
        used = list(dict.fromkeys([self.entity_key, *([self.time_key] if self.time_key else []), *self.tiebreak, *(self.columns or df.columns)]))
        function, key, at, order, policy, as_text = self.function, self.entity_key, self.time_key, [*([self.time_key] if self.time_key else []), *self.tiebreak], self.retry, self.output == "string"
        kind, arrow = df.schema[key].dataType.simpleString(), to_arrow_type(DataType.fromDDL(self.output))

        def shown(output: Any) -> Any:
            """The output as the envelope holds it; one that can't be held is the function's failure."""
            if as_text:
                return jsonable(output)
            pa.array([output], arrow)
            return output

        def one(ids: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            began, attempts, output, failure = time.perf_counter(), 1, None, (None, None, None)
            with MemoryScope() as scope:
                try:
                    own = frame.sort_values(order, kind="stable").reset_index(drop=True) if order else frame
                    output, attempts = policy.run(lambda n: shown(function(own.copy(), EntityContext(ids[0], key, at, n))), any_error=True)
                except RetriesExhausted as error:
                    attempts, cause = error.attempts, error.cause
                    failure = (type(cause).__name__, str(cause), "".join(traceback.format_exception(cause)))
                except Exception as error:  # the frame itself can't be ordered
                    failure = (type(error).__name__, str(error), traceback.format_exc())
            ok = failure[0] is None
            return pd.DataFrame([[ids[0], ok, time.perf_counter() - began, scope.delta_mb, attempts, *failure, output if ok else None]], columns=["entity_id", *(x.split()[0] for x in STATUS.split(", ")), "output"])

        return df.where(F.col(key).isNotNull()).select(*used).groupBy(key).applyInPandas(one, f"entity_id {kind}, {STATUS}, output {self.output}")

    def todo(self, df: DataFrame) -> DataFrame:
        """The rows of entities to process: the limit comes before what is completed is left out."""
        limited = series.first_entities(df, self.entity_key, self.max_entities)
        if not (self.checkpoint and self.resume):
            return limited
        return series.pending(limited, self.checkpoint.completed_frame(df.sparkSession), self.entity_key)

    def run(self, df: DataFrame) -> EntityFlowResult:
        """Processes all entities once; results are stored, so counts and outputs don't run the function again."""
        self.validate(df)
        result = EntityFlowResult(stored(self.envelopes(self.todo(df))), ordered=self.sort_entities)
        if self.checkpoint:
            self.checkpoint.append_frame(log_entries(result.envelopes))
        return result

    def process_entity(self, df: DataFrame, entity: Any) -> DataFrame:
        """The envelope of one entity; an unknown one is a KeyError."""
        own = df.where(F.col(self.entity_key) == F.lit(entity))
        if own.isEmpty():
            raise KeyError(entity)
        return self.envelopes(own)


class EntityFlowResult:
    """Stored envelopes of a run."""

    def __init__(self, envelopes: DataFrame, *, ordered: bool = True):
        self.envelopes = envelopes.orderBy("entity_id") if ordered else envelopes
        self._counts: tuple[int, int] | None = None

    def _count(self) -> tuple[int, int]:
        if self._counts is None:
            self._counts = tuple(self.envelopes.agg(F.count("*"), F.count_if("success")).first())
        return self._counts

    processed = property(lambda self: self._count()[0])
    succeeded = property(lambda self: self._count()[1])
    failed = property(lambda self: self._count()[0] - self._count()[1])

    def outputs(self) -> DataFrame:
        return self.envelopes.where("success").select("entity_id", "output")

    def by_entity(self, entity: Any) -> DataFrame:
        return self.envelopes.where(F.col("entity_id") == F.lit(entity))


def log_entries(envelopes: DataFrame) -> DataFrame:
    """Envelopes as entries of a checkpoint log."""
    status = F.when(F.col("success"), COMPLETED).otherwise(FAILED)
    return envelopes.select(F.col("entity_id").cast("string").alias("entity_id"), status.alias("status"), "runtime_seconds", "memory_delta_mb", "attempts", "error_message")


class EntityFlowFunction:
    """What entity_flow() makes of a function: still callable with a context, and runnable over a DataFrame."""

    __entity_flow__ = True

    def __init__(self, function: Callable, flow: EntityFlow):
        self.function, self.flow, self.__name__ = function, flow, getattr(function, "__name__", "flow")

    entity_key = property(lambda self: self.flow.entity_key)
    entity_column = entity_key
    time_key = property(lambda self: self.flow.time_key)

    def __call__(self, frame: pd.DataFrame, ctx: EntityContext | None = None) -> Any:
        if ctx is None:
            raise TypeError("an entity flow needs a context; use .run(df) for a DataFrame")
        return self.function(frame, ctx)

    def run(self, df: DataFrame) -> EntityFlowResult:
        return self.flow.run(df)

    def envelopes(self, df: DataFrame) -> DataFrame:
        return self.flow.envelopes(df)


def entity_flow(*, entity_key: str | None = None, entity_column: str | None = None, time_key: str, **options: Any) -> Callable[[Callable], EntityFlowFunction]:
    """Decorator of a function (frame, context)."""
    key = series.entity_column_name(entity_key, entity_column)
    return lambda function: EntityFlowFunction(function, EntityFlow(function, entity_key=key, time_key=time_key, **options))
