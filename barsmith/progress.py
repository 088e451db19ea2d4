"""Progress lines with an estimate of what is left, and recorded times."""

from __future__ import annotations

import functools
import logging
import shutil
import sys
import time
from collections.abc import Callable


def elapsed_text(seconds: float) -> str:
    s = int(max(0.0, seconds))
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"


class Progress:
    """A line on a stream, drawn at most every `interval` seconds and as wide as the terminal; nothing if not enabled."""

    def __init__(self, total: int, label: str, stream=None, enabled: bool | None = None, interval: float = 0.2, clock: Callable[[], float] = time.monotonic):
        self.total, self.label, self.done, self.clock, self.interval = max(total, 1), label, 0, clock, interval
        self.stream = stream or sys.stderr
        self.enabled = self.stream.isatty() if enabled is None else enabled
        self.began, self.drawn = clock(), -float("inf")

    def text(self, width: int = 80, detail: str = "") -> str:
        spent = self.clock() - self.began
        left = spent / self.done * (self.total - self.done) if self.done else 0.0
        tail = f" {self.done}/{self.total} {elapsed_text(spent)} left {elapsed_text(left)} {detail}".rstrip()
        room = max(width - len(self.label) - len(tail) - 4, 5)
        full = room * self.done // self.total
        return f"{self.label} [{'#' * full}{'.' * (room - full)}]{tail}"[:width]

    def advance(self, n: int = 1, detail: str = "") -> None:
        self.done = min(self.total, self.done + n)
        now = self.clock()
        if self.enabled and (now - self.drawn >= self.interval or self.done == self.total):
            self.drawn = now
            self.stream.write("\r" + self.text(shutil.get_terminal_size().columns, detail) + ("\n" if self.done == self.total else ""))
            self.stream.flush()


class Timings:
    """Seconds spent per name."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    def track(self, name: str):
        def wrap(f):
            @functools.wraps(f)
            def timed(*a, **k):
                began = time.perf_counter()
                try:
                    return f(*a, **k)
                finally:
                    self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

            return timed

        return wrap


def log_elapsed(logger: logging.Logger, label: str):
    """Log a function's time when it ends, however it does."""

    def wrap(f):
        @functools.wraps(f)
        def timed(*a, **k):
            began = time.perf_counter()
            try:
                return f(*a, **k)
            finally:
                logger.info("%s: %.3f s", label, time.perf_counter() - began)

        return timed

    return wrap
