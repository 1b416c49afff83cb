"""Mixing sources to target weights: whole copies first, then a Pareto order sample for what is left.

Each source's target is its share by weight of all words, at most `most` times its own size; what is cut off there is
shared again by weight. A source takes every document floor(target / size) times. For the rest a document has inclusion
odds in proportion to its size, and documents are ranked by random odds divided by inclusion odds; the source takes the
ranks up to the place nearest its target. Random numbers come from a digest of seed and id, so reruns agree.

No source is sorted as one group: ranks are cut into buckets of equal width, words are summed by bucket, and only the
bucket that holds the cut is ranked row by row.

Defined cases: a null text has size 0, is never chosen by rank and takes 0 words. Null sources are one source, after all
others. Null ids draw the number of the empty id. Rows that repeat an id and text are chosen or left together. A table
without words has targets of 0; an empty table gives an empty table. Other columns are ignored, or passed on by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Scratch, table

BUCKETS = 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float, share: float) -> DataFrame:
    """From (source, size) rows: source, source_size, n_rows, target, whole, rest (words that the sample is to take).

    Sources fill up in the order of the weight at which they reach their limit, so one running sum finds the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("limit_per_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table_of = F.array(*map(F.lit, map(float, weights)))
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n_sized"))
        .withColumn("weight", F.get(table_of, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("limit_per_weight", F.col("limit") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(filling), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("limit_per_weight") >= F.col("level"), F.struct("limit_per_weight", "level"))).over(all_rows)["level"])
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
    )
    ratio = F.col("target") / F.col("source_size")
    return found.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long")).select(
        "source", "source_size", "n_sized", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    )


def _rank(seed: str) -> Column:
    """Random odds divided by inclusion odds; null for rows that no sample takes."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    part = F.col("rest") / F.col("source_size")
    mean = F.col("source_size") / F.col("n_sized")
    p = part * F.col("size") / (part * F.col("size") + (1 - part) * mean)
    return F.when((F.col("size") > 0) & (F.col("rest") > 0), u * (1 - p) / ((1 - u) * p))


def _plan(rows: DataFrame, sizes: DataFrame, weights, most: float, share: float, seed: str, buckets: int, scratch: Scratch) -> DataFrame:
    """rows (row_id, source, size and others) with source_size, target and copies."""
    targets = scratch.keep(source_targets(sizes, weights, most, share), "targets")
    bucket = F.floor(buckets * (F.col("rank") / (1 + F.col("rank"))))

    def ranked(frame: DataFrame, with_columns: list) -> DataFrame:
        right = targets.withColumnRenamed("source", "t_source")
        return frame.join(right, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source").select(*with_columns, _rank(seed).alias("rank")).withColumn("bucket", bucket)

    every = ranked(sizes, ["source", "row_id", "size", "rest"]).where("rank is not null")
    up_to = Window.partitionBy("source").orderBy("bucket")
    sums = every.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words")).withColumn("after", F.sum("words").over(up_to))
    cut = sums.where((F.col("after") > F.col("rest")) & (F.col("after") - F.col("words") <= F.col("rest"))).select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), (F.col("after") - F.col("words")).alias("before"))
    inside = every.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
    so_far = Window.partitionBy("source").orderBy("rank", F.col("row_id").asc_nulls_first())
    taken = inside.withColumn("sum", F.col("before") + F.sum("size").over(so_far)).where(2 * F.col("sum") - F.col("size") <= 2 * F.col("rest"))
    last = taken.groupBy("source").agg(F.max(F.struct("rank", F.coalesce("row_id", F.lit(-(2**63))).alias("id"))).alias("last"))
    cuts = scratch.keep(cut.join(last, F.col("c_source").eqNullSafe(F.col("source")), "left").select("c_source", "c_bucket", "last"), "cuts")

    placed = ranked(rows, [*rows.columns, "source_size", "target", "whole", "rest"]).join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    here = F.struct("rank", F.coalesce("row_id", F.lit(-(2**63))).alias("id"))
    chosen = F.col("rank").isNotNull() & (F.col("c_bucket").isNull() | (F.col("bucket") < F.col("c_bucket")) | ((F.col("bucket") == F.col("c_bucket")) & F.coalesce(here <= F.col("last"), F.lit(False))))
    return placed.select(*rows.columns, F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", (F.coalesce("whole", F.lit(0)) + chosen.cast("long")).alias("copies"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3, share: float = 1.0, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """row_id, source, size, source_size, target and copies of each row; texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")), "sizes")
    return _plan(sizes, sizes, weights, most, share, seed, buckets, scratch)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3, share: float = 1.0, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """The input's rows, each as often as the mix takes it, with the input's columns."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = [F.col(id_col).cast("long").alias("row_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")]
    sizes = scratch.keep(docs.select(*own), "sizes")
    rows = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    planned = _plan(rows, sizes, weights, most, share, seed, buckets, scratch).where("copies > 0")
    return planned.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("whole_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the words that the mix takes of every document."""
    planned = mix_plan(table(spark, sf_dir, "documents"))
    return planned.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS n_sized,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS cap_per_weight FROM s
), g AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
  FROM f WINDOW w AS (ORDER BY cap_per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, least(cap, (SELECT arg_min(lev, (cap_per_weight, lev)) FROM g WHERE cap_per_weight >= lev) * weight) AS target FROM g
), t AS (
  SELECT source, source_size, n_sized, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM h
), r AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.n_sized, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         (CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CASE WHEN size > 0 AND rest > 0 THEN rest / source_size * size / (rest / source_size * size + (1 - rest / source_size) * (CAST(source_size AS DOUBLE) / n_sized)) END AS p FROM r
), k AS (
  SELECT *, u * (1 - p) / ((1 - u) * p) AS pareto FROM p
), c AS (
  SELECT *, sum(CASE WHEN pareto IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY pareto NULLS LAST, doc_id) AS so_far FROM k
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN pareto IS NOT NULL AND 2 * so_far - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
