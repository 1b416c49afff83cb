"""Batches of events that count once: protocol checks, idempotent commits and replay.

A batch is N url events and then one summary. Its rows are written to the partition of its id, so that a batch that comes
again writes the same files again; what was committed is read from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def protocol_faults(events: DataFrame) -> DataFrame:
    """batch_id and fault of each batch that is not url events followed by one summary. events: batch_id, ord, type."""
    summary = F.col("type") == "summary"
    counted = events.groupBy("batch_id").agg(F.count(F.when(summary, 1)).alias("summaries"), F.max(F.when(summary, F.col("ord"))).alias("at"), F.max("ord").alias("last"), F.count(F.when(~F.col("type").isin("url", "summary"), 1)).alias("others"))
    fault = F.when(F.col("others") > 0, "unknown event").when(F.col("summaries") == 0, "no summary").when(F.col("summaries") > 1, "several summaries").when(F.col("at") != F.col("last"), "events after the summary")
    return counted.select("batch_id", fault.alias("fault")).where("fault is not null")


def count_faults(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """Batches whose summary counts (raw, valid) are not those of their events. events: batch_id, canonical_url."""
    found = events.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count("canonical_url").alias("v"))
    joined = summaries.join(found, "batch_id", "left")
    return joined.where((F.col("raw") != F.coalesce("n", F.lit(0))) | (F.col("valid") != F.coalesce("v", F.lit(0)))).select("batch_id", "raw", "n", "valid", "v")


def committed(spark, path: str) -> DataFrame | None:
    """The ids of batches in a table; None before the first."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    return spark.read.parquet(path).select("batch_id").distinct()


def commit(rows: DataFrame, path: str) -> None:
    """Writes the partitions of the batches in rows, and no others: again is the same as once.

    Batches that break the protocol are refused as a whole.
    """
    bad = [f"{r.batch_id}: {r.fault}" for r in protocol_faults(rows).orderBy("batch_id").limit(5).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def not_ingested(batches: DataFrame, state: DataFrame) -> DataFrame:
    """Committed batches that a state does not know yet, in order of commit."""
    return batches.join(state.select("batch_id"), "batch_id", "left_anti").orderBy("commit_ord")


def ingest_stream(events: DataFrame, path: str, checkpoint: str):
    """A started query that commits whole batches of a stream of events (batch_id, ord, type and others) as they come."""

    def each(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            commit(rows, path)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_failures(failures: DataFrame, routes: dict[str, str], default: str = "retry") -> DataFrame:
    """failures with what to do by category."""
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return failures.withColumn("disposition", F.coalesce(F.try_element_at(table, F.col("category")), F.lit(default)))
