"""Progress, estimated time, and log helpers."""

from __future__ import annotations

import logging
import time
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

_LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


def percent(current: int, total: int) -> float:
    return 100.0 * current / total if total else 0.0


def eta_seconds(elapsed: float, current: int, total: int) -> float:
    return elapsed * total / current - elapsed if current else 0.0


def bar(current: int, total: int, width: int = 40) -> str:
    done = min(width, int(width * current / total)) if total else 0
    return f"[{'█' * done}{'░' * (width - done)}] {percent(current, total):.1f}%"


class Tracker:
    """Counts and shows at most ten lines a second."""

    def __init__(self, total: int, show=print, every: float = 0.1):
        self.total, self.current, self.show, self.every = total, 0, show, every
        self.began, self.shown = time.monotonic(), 0.0

    def set(self, current: int) -> None:
        self.current = current
        now = time.monotonic()
        if now - self.shown >= self.every or current >= self.total:
            self.shown = now
            left = eta_seconds(now - self.began, current, self.total)
            self.show(f"{bar(current, self.total)} {current}/{self.total}, {left:.0f} s left")

    def update(self, n: int = 1) -> None:
        self.set(self.current + n)

    def complete(self) -> None:
        self.set(self.total)


def running_tasks(spark: SparkSession) -> tuple[int, int]:
    """(finished, all) tasks of the active stages."""
    t = spark.sparkContext.statusTracker()
    stages = [s for s in map(t.getStageInfo, t.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


def pool_stats(spark: SparkSession) -> dict[str, int]:
    """What a pool of workers would tell of its queue, from Spark's scheduler: slots, jobs, and tasks that wait, run and are done."""
    t = spark.sparkContext.statusTracker()
    stages = [s for s in map(t.getStageInfo, t.getActiveStageIds()) if s]
    running, done, every = (sum(getattr(s, k) for s in stages) for k in ("numActiveTasks", "numCompletedTasks", "numTasks"))
    return {"workers": spark.sparkContext.defaultParallelism, "jobs": len(t.getActiveJobsIds()), "queued": every - running - done, "running": running, "done": done}


def logger(name: str = "lumenfold", level: str = "info", file: str | None = None, max_mb: int = 100, backups: int = 5) -> logging.Logger:
    """A named logger; unknown levels mean info."""
    log = logging.getLogger(name)
    log.setLevel(_LEVELS.get(level.lower(), logging.INFO))
    handler = RotatingFileHandler(file, maxBytes=max_mb << 20, backupCount=backups) if file else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    log.addHandler(handler)
    return log


def log_performance(log: logging.Logger, what: str, items: int, seconds: float) -> float:
    rate = items / seconds if seconds > 0 else 0.0
    log.info("%s: %d items in %.2f s (%.1f a second)", what, items, seconds, rate)
    return rate
