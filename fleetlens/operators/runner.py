"""Batched runs of a flow over a source, with checkpoints and resume.

The pending rows are written once, a folder for each batch, so a batch reads its own rows alone; each batch's envelopes are a folder of one table, read once
at the end. `workers` batches run at a time, each a job of its own. Without a checkpoint and without fail_fast there is nothing to do between batches, and
all of them run as one job.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.errors import EntityFailed
from fleetlens.operators import series
from fleetlens.operators.checkpoint import CheckpointBackend
from fleetlens.operators.durable import new_path, stored
from fleetlens.operators.flow import EntityFlow, EntityFlowFunction, RunSummary, log_entries
from fleetlens.operators.retry import RetryPolicy

log = logging.getLogger("fleetlens.runner")


class EntityRunner:
    def __init__(self, *, source: Any, flow: EntityFlow | EntityFlowFunction, checkpoint: CheckpointBackend | None = None, batch_size: int = 100, workers: int = 1, retries: int = 3, resume: bool = True, fail_fast: bool = False, retry_policy: RetryPolicy | None = None, progress: Callable[[str], None] | None = None):
        if batch_size < 1 or workers < 1 or retries < 1:
            raise ValueError("batch_size, workers and retries must be positive")
        self.flow = flow.flow if isinstance(flow, EntityFlowFunction) else flow
        if not isinstance(self.flow, EntityFlow):
            raise TypeError("flow must be an entity flow")
        self.source, self.checkpoint, self.batch_size, self.workers, self.resume, self.fail_fast = source, checkpoint, batch_size, workers, resume, fail_fast
        self.policy = (retry_policy or RetryPolicy(jitter=False)).with_attempts(retries)
        self.progress = progress or log.info

    def run(self, spark: SparkSession) -> RunSummary:
        began = time.time()
        if hasattr(self.source, "validate"):
            self.source.validate(spark)
        df = self.source if isinstance(self.source, DataFrame) else self.source.dataframe(spark)
        self.flow.validate(df)
        key, todo = self.flow.entity_key, df.where(F.col(self.flow.entity_key).isNotNull())
        out = RunSummary()
        if self.checkpoint and self.resume:
            done = stored(self.checkpoint.completed_frame(spark))
            out.skipped = series.skipped(todo, done, key)
            todo = series.pending(todo, done, key)
        flow = EntityFlow(self.flow.function, entity_key=key, time_key=self.flow.time_key, output=self.flow.output, columns=self.flow.columns, tiebreak=self.flow.tiebreak, retry=self.policy)
        assigned = stored(series.batches(todo, key, self.batch_size))
        out.batches = (assigned.agg(F.max("batch")).first()[0] if not assigned.isEmpty() else -1) + 1
        if out.batches and not (self.checkpoint or self.fail_fast):
            out.counted(stored(flow.envelopes(todo)))
        elif out.batches:
            out.counted(self._batches(flow, stored(todo.join(assigned, key), by="batch"), out.batches))
        out.runtime_seconds = time.time() - began
        self.progress(out.text())
        return out

    def _batches(self, flow: EntityFlow, rows: DataFrame, n: int) -> DataFrame:
        """The envelopes of all batches; fail_fast begins no batch behind a failed one."""
        target, one_at_a_time = new_path(rows.sparkSession, "envelopes"), threading.Lock()
        schema = flow.envelopes(rows.drop("batch")).schema

        def run(batch: int) -> None:
            part = stored(flow.envelopes(rows.where(F.col("batch") == batch).drop("batch")), at=f"{target}/batch={batch}")
            with one_at_a_time:  # the log has one writer
                if self.checkpoint:
                    self.checkpoint.append_frame(log_entries(part))
                self.progress(f"batch {batch + 1} of {n} done")
            if self.fail_fast and (bad := part.where("NOT success").orderBy("entity_id").first()):
                raise EntityFailed(bad.entity_id, f"{bad.error_type}: {bad.error_message}")

        if self.workers == 1:
            for batch in range(n):
                run(batch)
        else:
            with ThreadPoolExecutor(self.workers) as pool:
                try:
                    for done in as_completed([pool.submit(run, batch) for batch in range(n)]):
                        done.result()
                finally:
                    pool.shutdown(cancel_futures=True)
        return rows.sparkSession.read.schema(schema).parquet(target).drop("batch")
