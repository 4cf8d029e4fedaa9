"""What a query's stages did, from Spark's own status store."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Report:
    seconds: float = 0.0
    stages: list[dict] = field(default_factory=list)


@contextmanager
def measured(spark: SparkSession, group: str) -> Iterator[Report]:
    """Run actions under a job group; afterwards the report holds each stage's tasks, failures and name."""
    context, out = spark.sparkContext, Report()
    context.setJobGroup(group, group)
    began = time.monotonic()
    try:
        yield out
    finally:
        out.seconds = time.monotonic() - began
        tracker = context.statusTracker()
        for job in sorted(tracker.getJobIdsForGroup(group)):
            info = tracker.getJobInfo(job)
            for s in info.stageIds if info else []:
                stage = tracker.getStageInfo(s)
                if stage:
                    out.stages.append({"stage": s, "name": stage.name, "tasks": stage.numTasks, "failed": stage.numFailedTasks})
        context.setLocalProperty("spark.jobGroup.id", None)


def dashboard(spark: SparkSession) -> dict:
    """Executors, their memory, and the jobs and stages that run now."""
    context = spark.sparkContext
    tracker = context.statusTracker()
    memory = context._jsc.sc().getExecutorMemoryStatus()
    stages = []
    for s in tracker.getActiveStageIds():
        info = tracker.getStageInfo(s)
        if info:
            stages.append({"stage": s, "name": info.name, "tasks": info.numTasks, "done": info.numCompletedTasks, "failed": info.numFailedTasks})
    return {"application": context.applicationId, "cores": context.defaultParallelism, "executors": memory.size(), "active_jobs": list(tracker.getActiveJobsIds()), "active_stages": stages}
