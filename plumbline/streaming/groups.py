"""A group of tasks that run in parallel and are committed in the order of their input, exactly once.

Results of all tasks are staged together by Spark's own tasks; what counts is the longest run of input numbers without a gap:
the first task that failed, or has not ended, stops the commit, and a later run of the group goes on from there. Each commit
is one version of the ledger (sources.versions), so a replay or a second writer commits nothing twice.

Defined cases: results of a task that is committed already, and second results of a task, are left out (the first by
attempt counts). An empty group, and one whose first task failed, commit nothing. Tasks without rows are committed too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import scan
from plumbline.sources.versions import Versions

TASKS, ROWS = "tasks", "rows"


def gap_free(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """task_id, ord and attempt of what may be committed now. tasks: task_id, ord (from 1), attempt, ok; done: task_id, ord of what is committed."""
    first = tasks.where("ok").groupBy("task_id", "ord").agg(F.min("attempt").alias("attempt"))
    fresh = first.join(done.select("task_id"), "task_id", "left_anti").withColumn("__new", F.lit(True))
    whole = fresh.unionByName(done.select("task_id", "ord", F.lit(None).cast(dict(first.dtypes)["attempt"]).alias("attempt"), F.lit(False).alias("__new")))
    placed = scan.numbered(whole, ["ord"], "__place")
    return placed.where("__new and ord = __place").select("task_id", "ord", "attempt")


def commit_group(store: Versions, tasks: DataFrame, rows: DataFrame) -> int:
    """Commits the results (rows: task_id, attempt and others) of the gap-free run, and says how many tasks are new."""
    base = store.version()
    known = store.tables(base)
    spark = tasks.sparkSession
    done = store.read(TASKS, base) if TASKS in known else spark.createDataFrame([], tasks.select("task_id", "ord").schema)
    now = gap_free(tasks, done)
    results = rows.join(now.select("task_id", "attempt", "ord"), ["task_id", "attempt"]).drop("attempt")
    held = store.read(ROWS, base) if ROWS in known else results.limit(0)
    staged = store.stage({TASKS: done.select("task_id", "ord").unionByName(now.select("task_id", "ord")), ROWS: held.unionByName(results)})
    before = done.count()
    after = spark.read.parquet(f"{store.root}/data/{staged[TASKS]['folder']}/{TASKS}").count()
    if after > before:
        store.commit(staged, base)
    return after - before
