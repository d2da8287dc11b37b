"""Progress of long actions: (completed, total) to a callback while Spark's tasks finish."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

Progress = Callable[[int, int], None]


def share_done(spark: SparkSession, group: str) -> float:
    """The share of tasks that are done, of those that the group's stages are known to have."""
    tracker = spark.sparkContext.statusTracker()
    done = known = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                done, known = done + s.numCompletedTasks, known + s.numTasks
    return done / known if known else 0.0


@contextmanager
def watched(spark: SparkSession, total: int, callback: Progress | None, every: float = 0.2) -> Iterator[None]:
    """Within, the callback gets (completed, total) whenever completed has grown, in proportion to the tasks done of all
    actions of this thread; (total, total) comes last, unless an error ends them. The callback runs in a thread of its
    own; what it raises is raised at the end."""
    if callback is None:
        yield
        return
    sc = spark.sparkContext
    group, over, failed = f"progress-{uuid.uuid4().hex}", threading.Event(), []
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    seen = 0

    def watch() -> None:
        nonlocal seen
        while not over.wait(every):
            now = min(int(total * share_done(spark, group)), total - 1)
            if now > seen:
                seen = now
                try:
                    callback(now, total)
                except Exception as error:  # raised by the caller's thread
                    failed.append(error)
                    return

    sc.setJobGroup(group, f"{total} replicates")
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    if failed:
        raise failed[0]
    callback(total, total)
