"""Cancelling work and asking how far it is."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    jobs: int
    tasks: int
    done: int
    failed: int

    @property
    def share(self) -> float:
        return self.done / self.tasks if self.tasks else 0.0


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[str]:
    """What this thread runs inside belongs to the group ``name``, which ``cancel`` ends from any thread."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def cancel(spark: SparkSession, name: str) -> None:
    """End the running jobs of a group; what waits for them gets an error."""
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> Progress:
    """Jobs of a group, and tasks of those of its stages that the scheduler still knows."""
    tracker = spark.sparkContext.statusTracker()
    jobs = list(tracker.getJobIdsForGroup(name))
    infos = [tracker.getJobInfo(j) for j in jobs]
    stages = [tracker.getStageInfo(s) for s in {s for i in infos if i for s in i.stageIds}]
    stages = [s for s in stages if s]
    return Progress(len(jobs), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages))
