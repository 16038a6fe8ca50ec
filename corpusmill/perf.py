"""Timers, metrics and bounded calls on the driver."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

A, B = TypeVar("A"), TypeVar("B")


class Metrics:
    """Named times and values of one run."""

    def __init__(self) -> None:
        self.began = time.perf_counter()
        self.open: dict[str, float] = {}
        self.values: dict[str, float] = {}
        self.memory = self.memory_mb()

    @staticmethod
    def memory_mb() -> float:
        """Peak resident memory of the driver's Python."""
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024

    def start(self, name: str) -> None:
        self.open[name] = time.perf_counter()

    def end(self, name: str) -> float:
        """Seconds since ``start``; 0 for a timer that never began."""
        took = time.perf_counter() - self.open.pop(name, time.perf_counter())
        self.values[name] = self.values.get(name, 0.0) + took
        return took

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        self.start(name)
        try:
            yield
        finally:
            self.end(name)

    def record(self, name: str, value: float) -> None:
        self.values[name] = value

    def get(self, name: str) -> float | None:
        return self.values.get(name)

    def report(self) -> dict:
        """K21."""
        return {"total_s": time.perf_counter() - self.began, "memory_mb": self.memory_mb(), "memory_delta_mb": self.memory_mb() - self.memory, "metrics": dict(self.values)}

    def over_memory(self, most_mb: float = 500) -> bool:
        """F19."""
        return self.memory_mb() > most_mb

    def wrap(self, name: str, f: Callable[..., B]) -> Callable[..., B]:
        def timed(*args: object, **named: object) -> B:
            with self.timed(name):
                return f(*args, **named)

        return timed


def run_batch(f: Callable[[A], B], items: Iterable[A], at_once: int = 5, timeout: float = 30.0, per_second: float | None = None) -> list[B | BaseException]:
    """V8: driver-side calls (such as independent Spark jobs) a few at a time.

    An item's result or its exception stands at its place. ``timeout`` bounds the wait
    for each; ``per_second`` the rate at which calls begin.
    """
    pool = ThreadPoolExecutor(at_once)
    try:
        waiting = []
        for item in items:
            waiting.append(pool.submit(f, item))
            if per_second:
                time.sleep(1 / per_second)
        out: list[B | BaseException] = []
        for job in waiting:
            try:
                out.append(job.result(timeout))
            except BaseException as error:  # noqa: BLE001 - handed to the caller
                out.append(error)
        return out
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
