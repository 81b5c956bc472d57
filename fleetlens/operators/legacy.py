"""Older ways to run a function per entity and to keep statuses, for code that still uses them."""

from __future__ import annotations

import functools
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from fleetlens.errors import EntityFailed, RetriesExhausted
from fleetlens.log import setup_logging
from fleetlens.operators import series
from fleetlens.operators.checkpoint import COMPLETED, FAILED, CheckpointBackend, LocalCheckpoint
from fleetlens.operators.durable import stored
from fleetlens.operators.flow import RunSummary, log_entries
from fleetlens.operators.memory import MemoryScope
from fleetlens.operators.retry import RetryPolicy


@dataclass(frozen=True)
class RunContext:
    """What a processor is told about its call; each attempt has one of its own."""

    entity_id: Any
    entity_column: str
    attempt: int = 1
    started_at: float = field(default_factory=time.time)

    def elapsed_seconds(self) -> float:
        return time.time() - self.started_at


def entity_processor(function: Callable) -> Callable:
    """Marks a function (frame, context) as a processor."""
    checked = validate_processor(function)

    @functools.wraps(checked)
    def marked(*args: Any) -> Any:
        return checked(*args)

    marked.__entity_processor__ = True
    return marked


def validate_processor(function: Any) -> Callable:
    """The function itself, or what an object calls `process`."""
    found = function if callable(function) else getattr(function, "process", None)
    if not callable(found):
        raise TypeError(f"{type(function).__name__} can't process entities: it is no function (frame, context)")
    return found


@dataclass(frozen=True)
class FlowConfig:
    """Options of a Flow. log_level None leaves logging as it is."""

    entity_column: str
    checkpoint_dir: str | None = None
    resume: bool = True
    fail_fast: bool = False
    retry_policy: RetryPolicy = field(default_factory=RetryPolicy)
    show_progress: bool = True
    track_memory: bool = True
    log_level: int | str | None = None
    sort_entities: bool = True
    max_entities: int | None = None

    def __post_init__(self) -> None:
        if not self.entity_column.strip():
            raise ValueError("the entity column needs a name")
        if self.max_entities is not None and self.max_entities < 1:
            raise ValueError("a limit of entities is 1 or more, or None")


class Flow:
    """A processor (frame, context) -> frame over all entities; rows in no order, errors retried as the policy says. EntityFlow is the newer way."""

    def __init__(self, processor: Any, config: FlowConfig, *, checkpoint: CheckpointBackend | None = None):
        warnings.warn("Flow is kept for older code; use EntityFlow", DeprecationWarning, stacklevel=2)
        self.processor, self.config = validate_processor(processor), config
        self.checkpoint = checkpoint or (LocalCheckpoint(config.checkpoint_dir) if config.checkpoint_dir else None)

    def run(self, df: DataFrame, schema: str) -> tuple[DataFrame | None, RunSummary]:
        """The rows that processors returned, of this DDL schema (None without a success), and the counts."""
        config, began, out = self.config, time.time(), RunSummary(batches=1)
        log = setup_logging(config.log_level) if config.log_level is not None else None
        key = config.entity_column
        series.require(df, key)
        todo = series.first_entities(df, key, config.max_entities)
        if self.checkpoint and config.resume:
            done = stored(self.checkpoint.completed_frame(df.sparkSession))
            out.skipped = series.skipped(todo, done, key)
            todo = series.pending(todo, done, key)
        both = stored(self._processed(todo, schema))
        out.counted(both.drop("rows"))
        if self.checkpoint:
            self.checkpoint.append_frame(log_entries(both))
        if config.fail_fast and (bad := both.where("NOT success").orderBy("entity_id").first()):
            raise EntityFailed(bad.entity_id, bad.error_message)
        out.runtime_seconds = time.time() - began
        if log and config.show_progress:
            log.info(out.text())
        rows = both.where("success").select("entity_id", F.posexplode("rows").alias("place", "r"))
        ordered = rows.orderBy("entity_id", "place") if config.sort_entities else rows
        return (ordered.select("r.*") if out.succeeded else None), out

    def _processed(self, todo: DataFrame, schema: str) -> DataFrame:
        processor, key, policy, tracked = self.processor, self.config.entity_column, self.config.retry_policy, self.config.track_memory
        kind, arrow = todo.schema[key].dataType.simpleString(), to_arrow_type(DataType.fromDDL(f"array<struct<{schema}>>"))

        def rows_of(out: Any) -> list[dict]:
            """The returned frame's rows; what can't be rows of the schema is the processor's failure."""
            if not isinstance(out, pd.DataFrame):
                raise TypeError(f"a processor returns a frame, not {type(out).__name__}")
            rows = out.astype(object).where(out.notna(), None).to_dict("records")
            pa.array([rows], arrow)
            return rows

        def one(ids: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            began, rows, failure = time.perf_counter(), [], None
            with MemoryScope() as scope:
                try:
                    rows, attempts = policy.run(lambda n: rows_of(processor(frame.copy(), RunContext(ids[0], key, n))))
                except RetriesExhausted as error:
                    attempts, failure = error.attempts, str(error)
            status = [ids[0], failure is None, attempts, time.perf_counter() - began, scope.delta_mb if tracked else 0.0, failure, rows]
            return pd.DataFrame([status], columns=["entity_id", "success", "attempts", "runtime_seconds", "memory_delta_mb", "error_message", "rows"])

        return todo.groupBy(key).applyInPandas(one, f"entity_id {kind}, success boolean, attempts int, runtime_seconds double, memory_delta_mb double, error_message string, rows array<struct<{schema}>>")


@dataclass
class Record:
    """A status as older code saves it."""

    entity_id: str
    success: bool
    completed_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    runtime_seconds: float = 0.0
    attempts: int = 1
    error: str | None = None


class RecordStore:
    """Records in a checkpoint log; a failure's time goes into its entry's metadata."""

    def __init__(self, backend: CheckpointBackend):
        self.backend = backend

    def save(self, record: Record) -> None:
        details = {"runtime_seconds": record.runtime_seconds, "attempts": record.attempts}
        if record.success:
            self.backend.mark_completed(record.entity_id, **details)
        else:
            self.backend.mark_failed(record.entity_id, error=record.error, metadata={"completed_at": record.completed_at}, **details)

    def load(self) -> dict[str, Record]:
        """The latest record of each entity."""
        return {k: Record(k, e.status == COMPLETED, e.metadata.get("completed_at", e.recorded_at) if e.status == FAILED else e.recorded_at, e.runtime_seconds, e.attempts, e.error_message) for k, e in self.backend.latest().items()}

    def is_done(self, entity: object) -> bool:
        return self.backend.is_completed(entity)

    def clear(self) -> None:
        self.backend.clear()
