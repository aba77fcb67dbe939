"""Running stages in order, with load types, retries, time limits and branches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import SparkSession

from lakemill.sources.landing import Forbidden


class LoadType(Enum):
    FULL = "full"
    RELOAD = "reload"
    INCREMENTAL = "incremental"
    TARGETED = "targeted"


@dataclass
class Run:
    """A run's parameters and its stages' results; all stages see its id."""

    load_type: LoadType = LoadType.INCREMENTAL
    keys: list[int] = field(default_factory=list)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    results: dict[str, object] = field(default_factory=dict)


class StageTimeout(TimeoutError):
    """A stage took longer than its limit; its Spark jobs were cancelled."""


@dataclass(frozen=True)
class Stage:
    """``limit``: seconds that an attempt may take."""

    name: str
    work: Callable[[Run], object]
    retries: int = 0
    when: Callable[[Run], bool] = lambda run: True
    limit: float | None = None


def _attempt(stage: Stage, run: Run, spark: SparkSession | None) -> object:
    """One attempt, in a thread of its own if it is limited. When time is up all jobs it has begun, known by their tag, are cancelled."""
    if stage.limit is None:
        return stage.work(run)
    tag, done = f"{stage.name}-{uuid.uuid4().hex}", {}

    def work() -> None:
        try:
            if spark is not None:
                spark.sparkContext.addJobTag(tag)
            done["result"] = stage.work(run)
        except BaseException as e:  # told to the caller below
            done["error"] = e

    thread = threading.Thread(target=work, name=tag, daemon=True)
    thread.start()
    thread.join(stage.limit)
    if thread.is_alive():
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(tag)
        raise StageTimeout(f"{stage.name}: more than {stage.limit} seconds")
    if "error" in done:
        raise done["error"]
    return done["result"]


def execute(stages: list[Stage], run: Run, spark: SparkSession | None = None) -> Run:
    """Each stage after the one before succeeded; a stage whose ``when`` is false is left out. The last error is raised, and at once if it says that the run must stop."""
    for stage in stages:
        if not stage.when(run):
            continue
        for attempt in range(stage.retries + 1):
            try:
                run.results[stage.name] = _attempt(stage, run, spark)
                break
            except Exception as e:
                if attempt == stage.retries or isinstance(e, Forbidden):
                    raise
    return run
