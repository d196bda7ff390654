"""Runs beside the caller: progress while they go on, and an end before their own."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..errors import ABORTED, SanitizerError


class Run:
    """Work in a thread of its own, whose jobs carry a tag: by the tag they are counted, and cancelled."""

    def __init__(self, spark: SparkSession, work: Callable[[], object], lines=None, on_progress: Callable[[dict], None] | None = None, every: float = 0.5):
        self.context, self.work, self.lines, self.on_progress, self.every = spark.sparkContext, work, lines, on_progress, every
        self.tag, self.aborted, self.error, self.value = f"veilspark-{uuid.uuid4().hex}", False, None, None
        self.thread = InheritableThread(target=self._go, session=spark)
        self.thread.daemon = True
        self.thread.start()
        if on_progress is not None:
            threading.Thread(target=self._report, daemon=True).start()

    def _go(self) -> None:
        self.context.addJobTag(self.tag)
        try:
            self.value = self.work()
        except Exception as e:
            self.error = e
        finally:
            self.context.removeJobTag(self.tag)

    def _report(self) -> None:
        while self.thread.is_alive():
            self.on_progress(self.progress())
            self.thread.join(self.every)
        self.on_progress(self.progress())

    def progress(self) -> dict:
        """Lines of tasks that have ended, and these tasks and all of the stages begun so far."""
        tracker, done, tasks, seen = self.context._jsc.sc().statusTracker(), 0, 0, set()
        for job in tracker.getJobIdsForTag(self.tag):
            told = tracker.getJobInfo(job)
            for stage in told.get().stageIds() if told.isDefined() else []:
                info = tracker.getStageInfo(stage)
                if stage not in seen and info.isDefined() and info.get().submissionTime() > 0:  # a stage whose output is there is not begun
                    seen.add(stage)
                    done, tasks = done + info.get().numCompletedTasks(), tasks + info.get().numTasks()
        return {"lines": self.lines.value if self.lines is not None else None, "tasks_done": done, "tasks": tasks}

    def abort(self) -> None:
        """Cancels the jobs that run, and those that the work would begin after them."""
        self.aborted = True

        def cancel() -> None:
            while self.thread.is_alive():
                self.context.cancelJobsWithTag(self.tag)
                time.sleep(0.05)

        threading.Thread(target=cancel, daemon=True).start()

    def result(self, timeout: float | None = None):
        """What the work gives; ABORTED if it was aborted before it had it."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError("the run goes on")
        if self.error is not None:
            if self.aborted:
                raise SanitizerError(ABORTED, "the run was aborted") from self.error
            raise self.error
        return self.value
