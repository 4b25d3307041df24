"""Progress of a fit: rows (stage, done, total, seconds), and the Spark jobs of each stage under a name of their own."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("loomspark")


@dataclass
class Progress:
    """Stages as they go: each report is kept, logged, and given to ``tell`` where there is one."""

    spark: SparkSession
    name: str = "fit"
    tell: Callable[[str, int, int, float], None] | None = None
    rows: list[tuple[str, int, int, float]] = field(default_factory=list)

    def report(self, stage: str, done: int, total: int, seconds: float) -> None:
        self.rows.append((stage, done, total, round(seconds, 3)))
        log.info("%s: %s %d of %d, %.1f s", self.name, stage, done, total, seconds)
        if self.tell:
            self.tell(stage, done, total, seconds)

    @contextmanager
    def stage(self, stage: str, total: int = 1) -> Iterator[None]:
        """Report 0 of ``total`` at the start and ``total`` at the end; jobs run in the group name:stage."""
        began, context = time.perf_counter(), self.spark.sparkContext
        before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
        context.setJobGroup(f"{self.name}:{stage}", f"{self.name}: {stage}")
        self.report(stage, 0, total, 0.0)
        try:
            yield
            self.report(stage, total, total, time.perf_counter() - began)
        finally:
            context.setLocalProperty("spark.jobGroup.id", before[0])
            context.setLocalProperty("spark.job.description", before[1])

    def jobs(self, stage: str) -> int:
        """Spark jobs of a stage so far."""
        return len(self.spark.sparkContext.statusTracker().getJobIdsForGroup(f"{self.name}:{stage}"))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "stage string, done int, total int, seconds double")
