"""The checkpoint log of entity runs, folded to the latest status of each entity.

Two places: LocalCheckpoint, JSON lines in a folder of the driver, for runs that fit its memory; SharedCheckpoint, a Parquet table in shared
storage, whose entries stay in DataFrames. Ids are kept as text. One writer at a time.
Field names of an entry (fixed values): entity_id, status, recorded_at, runtime_seconds, memory_delta_mb, attempts, error_message, metadata.
"""

from __future__ import annotations

import json
import os
import time
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.errors import CheckpointError
from fleetlens.operators.durable import deleted, exists

COMPLETED, FAILED = "completed", "failed"
ENTRY = "entity_id string, status string, recorded_at string, runtime_seconds double, memory_delta_mb double, attempts int, error_message string, metadata map<string,string>"


@dataclass
class Entry:
    entity_id: str
    status: str
    recorded_at: str = ""
    runtime_seconds: float = 0.0
    memory_delta_mb: float = 0.0
    attempts: int = 1
    error_message: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, record: dict[str, Any]) -> Entry:
        known = {k: v for k, v in record.items() if k in cls.__dataclass_fields__}
        return cls(**known | {"entity_id": str(known["entity_id"])})


class CheckpointBackend(ABC):
    """Where statuses are kept."""

    @abstractmethod
    def append(self, entries: Iterable[Entry]) -> None: ...

    @abstractmethod
    def entries(self) -> list[Entry]: ...

    @abstractmethod
    def clear(self) -> None: ...

    def append_frame(self, entries: DataFrame) -> None:
        """The rows of entries (columns of ENTRY, or some of them)."""
        self.append(Entry.of({k: v for k, v in r.asDict().items() if v is not None}) for r in entries.toLocalIterator())

    def completed_frame(self, spark: SparkSession) -> DataFrame:
        """entity_id of what is completed."""
        return spark.createDataFrame([(x,) for x in sorted(self.completed())], "entity_id string")

    def latest(self) -> dict[str, Entry]:
        return {e.entity_id: e for e in self.entries()}

    def completed(self) -> set[str]:
        return {k for k, e in self.latest().items() if e.status == COMPLETED}

    def failed(self) -> set[str]:
        return {k for k, e in self.latest().items() if e.status == FAILED}

    def is_completed(self, entity: object) -> bool:
        return str(entity) in self.completed()

    should_skip = is_completed

    def mark_completed(self, entity: object, *, error: object = None, **details: Any) -> None:
        """Does nothing for an entity that is completed already."""
        if not self.is_completed(entity):
            self.append([Entry(str(entity), COMPLETED, **details)])

    def mark_failed(self, entity: object, *, error: object = None, **details: Any) -> None:
        if not self.is_completed(entity):
            self.append([Entry(str(entity), FAILED, error_message=None if error is None else str(error), **details)])

    def summary(self) -> dict[str, Any]:
        entries, done, bad = self.entries(), self.completed(), self.failed()
        return {"completed": len(done), "failed": len(bad), "total_entries": len(entries), "completed_ids": done, "failed_ids": bad, "tracked_entities": len(done) + len(bad)}


class LocalCheckpoint(CheckpointBackend):
    """A log file checkpoints.jsonl in a folder of the driver."""

    def __init__(self, directory: str):
        self.path = os.path.join(directory, "checkpoints.jsonl")
        os.makedirs(directory, exist_ok=True)
        self._seen: tuple[tuple[int, int], list[Entry], dict[str, Entry]] | None = None  # the file's time and size, and what it held then

    def _stamp(self) -> tuple[int, int]:
        found = os.stat(self.path) if os.path.exists(self.path) else None
        return (found.st_mtime_ns, found.st_size) if found else (0, 0)

    def _state(self) -> tuple[list[Entry], dict[str, Entry]]:
        """Entries and latest ones; the file is parsed again only if someone else wrote it."""
        if self._seen is None or self._seen[0] != self._stamp():
            entries = self._parsed()
            self._seen = (self._stamp(), entries, {e.entity_id: e for e in entries})
        return self._seen[1:]

    def entries(self) -> list[Entry]:
        return list(self._state()[0])

    def latest(self) -> dict[str, Entry]:
        return dict(self._state()[1])

    def is_completed(self, entity: object) -> bool:
        found = self._state()[1].get(str(entity))
        return found is not None and found.status == COMPLETED

    should_skip = is_completed

    def append(self, entries: Iterable[Entry]) -> None:
        now = datetime.now(UTC).isoformat()
        new = [Entry(**asdict(e) | {"recorded_at": e.recorded_at or now}) for e in entries]
        lines = [json.dumps(asdict(e)) for e in new]
        if not lines:
            return
        try:
            known = self._state()
            self._mend()
            with open(self.path, "a", encoding="utf-8") as file:
                file.write("".join(x + "\n" for x in lines))
                file.flush()
                os.fsync(file.fileno())
            known[0].extend(new)
            known[1].update((e.entity_id, e) for e in new)
            self._seen = (self._stamp(), *known)
        except OSError as error:
            raise CheckpointError(f"{self.path} can't be written: {error}") from error

    def _mend(self) -> None:
        """A last line that was cut off goes, so that a new one doesn't run into it."""
        if not os.path.exists(self.path) or not (size := os.path.getsize(self.path)):
            return
        with open(self.path, "rb+") as file:
            data = file.read()
            if data.endswith(b"\n"):
                return
            start = data.rfind(b"\n") + 1
            try:
                json.loads(data[start:])
                file.seek(size)
                file.write(b"\n")
            except ValueError:
                file.truncate(start)

    def _parsed(self) -> list[Entry]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as file:
            lines = file.read().split("\n")
        last = max((i for i, x in enumerate(lines) if x.strip()), default=-1)
        out = []
        for i, line in enumerate(lines):
            if not line.strip():
                continue
            try:
                record = json.loads(line)
            except ValueError as error:
                if i == last:
                    break  # cut off while it was written
                raise CheckpointError(f"{self.path}, line {i + 1} is corrupt") from error
            if not isinstance(record, dict):
                raise CheckpointError(f"{self.path}, line {i + 1} is no object")
            out.append(Entry.of(record))
        return out

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        """The entries with `seq`, their order."""
        rows = [(i, *(getattr(e, c) for c in Entry.__dataclass_fields__)) for i, e in enumerate(self.entries())]
        return spark.createDataFrame(rows, f"seq long, {ENTRY}")


class SharedCheckpoint(CheckpointBackend):
    """A log as a Parquet table at a path that all executors share. Each append adds files; `seq` orders entries by append and place in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: Iterable[Entry]) -> None:
        rows = [tuple(asdict(e).values()) for e in entries]
        if rows:
            self.append_frame(self.spark.createDataFrame(rows, ENTRY))

    def append_frame(self, entries: DataFrame) -> None:
        kinds = dict(x.strip().split(" ", 1) for x in ENTRY.split(", "))
        now = F.lit(datetime.now(UTC).isoformat())
        full = entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
        seq = F.struct(F.lit(time.time_ns()).alias("append"), F.monotonically_increasing_id().alias("place"))
        full.withColumns({"recorded_at": F.coalesce(F.nullif("recorded_at", F.lit("")), now), "seq": seq}).write.mode("append").parquet(self.path)

    def dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        layout = f"{ENTRY}, seq struct<append:bigint,place:bigint>"
        return self.spark.read.schema(layout).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], layout)

    def completed_frame(self, spark: SparkSession) -> DataFrame:
        return latest_status(self.dataframe().select("entity_id", "status", "seq")).where(F.col("status") == COMPLETED).select("entity_id")

    def entries(self) -> list[Entry]:
        return [Entry.of(r.asDict()) for r in self.dataframe().orderBy("seq").drop("seq").toLocalIterator()]

    def is_completed(self, entity: object) -> bool:
        last = latest_status(self.dataframe().where(F.col("entity_id") == str(entity)).select("entity_id", "status", "seq")).first()
        return last is not None and last.status == COMPLETED

    should_skip = is_completed

    def clear(self) -> None:
        deleted(self.spark, self.path)


def latest_status(log: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """The last row of each entity; an aggregate, so a busy entity is folded before the exchange."""
    rest = [c for c in log.columns if c != entity]
    return log.groupBy(entity).agg(F.max_by(F.struct(*rest), order).alias("last")).select(entity, "last.*")


def status_summary(log: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """One row: completed, failed, tracked_entities, total_entries."""
    last = log.groupBy(entity).agg(F.max_by("status", order).alias("status"), F.count("*").alias("n"))
    done, bad = F.count_if(F.col("status") == COMPLETED), F.count_if(F.col("status") == FAILED)
    return last.agg(done.alias("completed"), bad.alias("failed"), (done + bad).alias("tracked_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"))


def new_entries(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The entries of fresh whose entity isn't completed in log; the first completed one of an entity ends its entries."""
    done = latest_status(log).where(F.col("status") == COMPLETED).select("entity_id")
    ended = F.min(F.when(F.col("status") == COMPLETED, F.col("seq"))).over(W.partitionBy("entity_id"))
    return fresh.join(done, "entity_id", "left_anti").withColumn("__end", ended).where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__end")
