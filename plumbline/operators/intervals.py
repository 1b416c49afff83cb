"""Intervals: unions and islands by one sorted pass a group, concurrency by a two-level scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import scan


def islands(rows: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """group, start and end of maximal covered stretches; touching intervals are one."""
    by = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = rows.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def covered(rows: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """The total length that a group's intervals cover, overlaps once."""
    return islands(rows, group, start, end).groupBy(group).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def peak(rows: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """The most intervals that are open at once; at one instant ends come before starts."""
    edges = rows.select(group, F.col(start).alias("t"), F.lit(1).alias("delta")).unionByName(rows.select(group, F.col(end).alias("t"), F.lit(-1).alias("delta")))
    return scan.peak_of(edges, group, ["t", "delta"], "delta")


def overlapping_pairs(left: DataFrame, right: DataFrame, group: str, width: float) -> DataFrame:
    """Pairs of one group whose half-open intervals overlap: both are cut into cells of a width, which meet on equality.

    A pair that shares several cells counts in the first of them.
    """
    cells = lambda f, a: f.withColumn(f"{a}_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    a, b = cells(left, "l"), cells(right, "r")
    joined = a.alias("l").join(b.alias("r"), (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l_cell") == F.col("r_cell")))
    first = F.floor(F.greatest(F.col("l.start"), F.col("r.start")) / width) == F.col("l_cell")
    return joined.where(first & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end")))


def merge_boxes(words: DataFrame, gap: float = 8.0) -> DataFrame:
    """Boxes of neighbouring words of a line as one. words: page, block, line, ord, x0, y0, x1, y1."""
    by = Window.partitionBy("page", "block", "line").orderBy("ord")
    fresh = F.when(F.coalesce(F.col("x0") - F.lag("x1").over(by) < gap, F.lit(False)), 0).otherwise(1)
    marked = words.withColumn("__new", fresh).withColumn("part", F.sum("__new").over(by))
    return marked.groupBy("page", "block", "line", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
