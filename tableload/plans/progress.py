"""Share of a write's tasks that are done, told while it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event, Thread

from pyspark import SparkContext
from pyspark.sql import SparkSession

_GROUP_PROPERTIES = ("spark.jobGroup.id", "spark.job.description")


def _tasks_done(context: SparkContext, group: str) -> tuple[int, int]:
    """(finished, all) tasks of the stages that the group's jobs have so far."""
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {s for job in jobs if job for s in job.stageIds}
    known = [info for info in map(tracker.getStageInfo, stages) if info]
    return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)


@contextmanager
def task_progress(
    spark: SparkSession, tell: Callable[[int], None], every: float
) -> Iterator[None]:
    """Call ``tell`` with rising percentages from 1 to 99 while the block's jobs run.

    Spark's status tracker is asked every ``every`` seconds, from a thread of its own. Stages
    planned later count once they are known; a percentage never falls for that. A ``tell`` that
    raises ends the telling, not the block.
    """
    context, group, done = spark.sparkContext, f"progress-{uuid.uuid4().hex}", Event()
    before = [context.getLocalProperty(p) for p in _GROUP_PROPERTIES]

    def watch() -> None:
        told = 0
        while not done.wait(every):
            finished, planned = _tasks_done(context, group)
            percent = min(99, 100 * finished // planned) if planned else 0
            if percent > told:
                told = percent
                tell(percent)

    watcher = Thread(target=watch, daemon=True)
    context.setJobGroup(group, before[1] or "load")
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        for key, value in zip(_GROUP_PROPERTIES, before):
            context.setLocalProperty(key, value)
