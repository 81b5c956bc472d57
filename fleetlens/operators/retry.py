"""Attempts of a call and the waits between them; runs in the worker, apart from Spark's own task retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from fleetlens.errors import RetriesExhausted

# Attempts, first and longest wait in seconds, growth of waits, spread of random ones, and errors worth another attempt.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, GROWTH, SPREAD = 3, 0.5, 30.0, 2.0, (0.5, 1.5)
TRANSIENT = (TimeoutError, ConnectionError, OSError)


class RetryPolicy:
    def __init__(self, max_attempts: int = ATTEMPTS, initial_delay_seconds: float = FIRST_WAIT, max_delay_seconds: float = LONGEST_WAIT, exponential_base: float = GROWTH, jitter: bool = True, retryable: tuple[type[BaseException], ...] = TRANSIENT):
        if max_attempts < 1:
            raise ValueError(f"a call needs an attempt, not {max_attempts}")
        self.max_attempts, self.first, self.longest, self.growth, self.jitter, self.retryable = max_attempts, initial_delay_seconds, max_delay_seconds, exponential_base, jitter, retryable

    def with_attempts(self, n: int) -> RetryPolicy:
        return RetryPolicy(n, self.first, self.longest, self.growth, self.jitter, self.retryable)

    def waits(self) -> Iterator[float]:
        """Seconds before each attempt of one run; nothing before the first."""
        yield 0.0
        grown = self.first
        for _ in range(1, self.max_attempts):
            yield min(grown, self.longest) * (random.uniform(*SPREAD) if self.jitter else 1.0)
            grown *= self.growth

    def delay(self, attempt: int) -> float:
        """The wait before this attempt (from 1), however many a run may have."""
        return next(islice(self.with_attempts(max(attempt, 1)).waits(), max(attempt, 1) - 1, None))

    def run(self, call: Callable[[int], Any], *, any_error: bool = False) -> tuple[Any, int]:
        """call(attempt)'s result and the attempts it took; any_error: try again whatever the error is."""
        failure: RetriesExhausted | None = None
        for attempt, wait in enumerate(self.waits(), 1):
            time.sleep(wait)
            try:
                return call(attempt), attempt
            except Exception as error:
                failure = RetriesExhausted(attempt, error)
                if not any_error and not isinstance(error, self.retryable):
                    break
        raise failure from failure.cause
