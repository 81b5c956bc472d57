"""Resident memory of this process. In a worker it is shared by the entities that the process handles, so differences are approximate."""

from __future__ import annotations

import functools
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("fleetlens.memory")


def resident_mb() -> float:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@dataclass
class MemoryScope:
    """Memory before and after a block: delta_mb is never negative."""

    warn_mb: float | None = None
    before_mb: float = 0.0
    after_mb: float = 0.0

    def __enter__(self) -> MemoryScope:
        self.before_mb = resident_mb()
        return self

    def __exit__(self, *_: object) -> None:
        self.after_mb = resident_mb()
        if self.warn_mb is not None and self.delta_mb >= self.warn_mb:
            log.warning("memory grew by %.1f MB", self.delta_mb)

    @property
    def delta_mb(self) -> float:
        return max(0.0, self.after_mb - self.before_mb)


@dataclass
class MemoryTracker:
    """Snapshots by label."""

    snapshots: list[tuple[str, float]] = field(default_factory=list)

    def snapshot(self, label: str = "") -> float:
        self.snapshots.append((label, resident_mb()))
        return self.snapshots[-1][1]

    @property
    def peak_mb(self) -> float:
        return max((mb for _, mb in self.snapshots), default=0.0)

    def reset(self) -> None:
        self.snapshots.clear()


def track_memory(function: Callable | None = None, *, warn_mb: float | None = None) -> Any:
    """Decorator that leaves the last call's scope in `last_memory`."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def inner(*args: Any, **kwargs: Any) -> Any:
            with MemoryScope(warn_mb) as scope:
                inner.last_memory = scope
                return f(*args, **kwargs)

        inner.last_memory = None
        return inner

    return wrap(function) if function else wrap
