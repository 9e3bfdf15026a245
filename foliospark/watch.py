"""Following a run and ending it: phases for an observer, cancellation, and a deadline that interrupts Spark's jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .tables import SharedTables


class Observer(Protocol):
    """Told of the phases of a run, one after the other."""

    def phase(self, description: str, total: int | None = None, unit: str = "") -> None: ...

    def advance(self) -> None: ...

    def phase_complete(self) -> None: ...


class Cancelled(RuntimeError):
    """The run was cancelled, or its deadline has passed."""


def _tagging(spark: SparkSession):
    """(add, remove, cancel) for a tag of the jobs of this thread, of the context or else, without one, of the session."""
    try:
        context = spark.sparkContext
        return context.addJobTag, context.removeJobTag, context.cancelJobsWithTag
    except (AttributeError, NotImplementedError):
        return spark.addTag, spark.removeTag, spark.interruptTag


class Watch:
    """Use it as a context; checks between phases, and ends the jobs of a phase at the deadline."""

    def __init__(self, spark: SparkSession, deadline_seconds: float | None = None, cancelled: Callable[[], bool] | None = None, observer: Observer | None = None):
        self.spark, self.deadline, self.cancelled, self.observer = spark, deadline_seconds, cancelled, observer
        self.begun, self.tag, self.timer = time.monotonic(), f"foliospark-{uuid.uuid4().hex}", None

    @property
    def seconds(self) -> float:
        return time.monotonic() - self.begun

    @property
    def expired(self) -> bool:
        return self.deadline is not None and self.seconds >= self.deadline

    def check(self) -> None:
        if self.cancelled is not None and self.cancelled():
            raise Cancelled("the run was cancelled")
        if self.expired:
            raise Cancelled("the run's deadline has passed")

    def __enter__(self) -> Watch:
        self.begun = time.monotonic()
        if self.deadline is not None:
            add, _, cancel = _tagging(self.spark)
            add(self.tag)
            self.timer = threading.Timer(self.deadline, cancel, [self.tag])
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, kind: Any, error: Any, trace: Any) -> None:
        if self.timer is not None:
            self.timer.cancel()
            _tagging(self.spark)[1](self.tag)
        if kind is not None and not issubclass(kind, Cancelled) and self.expired:
            raise Cancelled("the run's deadline has passed") from error

    @contextmanager
    def phase(self, description: str) -> Iterator[None]:
        self.check()
        if self.observer is not None:
            self.observer.phase(description, 1, "table")
        yield
        if self.observer is not None:
            self.observer.advance()
            self.observer.phase_complete()


class WatchedTables(SharedTables):
    """Shared tables; writing one is a phase."""

    def __init__(self, spark: SparkSession, watch: Watch):
        super().__init__(spark)
        self.watch = watch

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with self.watch.phase(name):
            return super().write(df, name)
