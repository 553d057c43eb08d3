"""What a query took: its rows by an observation on its plan, and each stage's tasks, rows and bytes, as one table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MEASURED = (
    "query string, rows_out long, seconds double, stage long, tasks long, rows_read long, bytes_read long, rows_written long, bytes_written long, "
    "shuffle_rows_read long, shuffle_bytes_read long, shuffle_bytes_written long, spilled_bytes long, task_seconds double, peak_bytes long"
)


def measured(spark: SparkSession, queries: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Runs each query once, without keeping its rows: a row for each stage that ran, among them those that ran while its plan was made, or one of null stage where none did.

    Stages are those of the jobs of the query's own group, so what else the application does is not counted. Skipped stages did not run. Raises RuntimeError where Spark has forgotten a stage that did.
    """
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    rows = []
    for name, make in queries.items():
        group = f"measured-{uuid.uuid4().hex}"
        counted = Observation(group)
        start = time.perf_counter()
        sc.setJobGroup(group, name)
        try:
            make().observe(counted, F.count(F.lit(1)).alias("rows_out")).write.format("noop").mode("overwrite").save()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.job.description", None)
        seconds, rows_out = time.perf_counter() - start, counted.get["rows_out"]
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = []
        for job in sc.statusTracker().getJobIdsForGroup(group):
            ran = 0
            for stage in sc.statusTracker().getJobInfo(job).stageIds:
                if sc.statusTracker().getStageInfo(stage) is None:  # forgotten: of more stages than spark.ui.retainedStages skipped ones go first
                    continue
                s = store.lastStageAttempt(stage)
                if s.status().toString() in ("COMPLETE", "FAILED"):
                    ran += 1
                    found.append((
                        int(stage), s.numTasks(), s.inputRecords(), s.inputBytes(), s.outputRecords(), s.outputBytes(), s.shuffleReadRecords(), s.shuffleReadBytes(),
                        s.shuffleWriteBytes(), s.diskBytesSpilled(), s.executorRunTime() / 1000.0, s.peakExecutionMemory(),
                    ))
            if ran < store.job(job).numCompletedStages():
                raise RuntimeError(f"stages of {name} are forgotten; raise spark.ui.retainedStages")
        rows += [(name, rows_out, seconds, *s) for s in sorted(set(found))] or [(name, rows_out, seconds, *[None] * 12)]
    return spark.createDataFrame(rows, MEASURED)


def totals(table: DataFrame) -> DataFrame:
    """query, rows_out, seconds, stages and the sums over them."""
    sums = ("tasks", "rows_read", "bytes_read", "shuffle_bytes_read", "shuffle_bytes_written", "spilled_bytes", "task_seconds")
    return table.groupBy("query").agg(F.max("rows_out").alias("rows_out"), F.max("seconds").alias("seconds"), F.count("stage").alias("stages"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
