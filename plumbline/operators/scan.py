"""Two-level prefix scans: running sums, extremes and neighbours of a key's rows, with one hot key in many tasks.

Rows are dealt by ranges of (key, order), so a large key has many ranges. Each range is scanned by itself; the totals of the
ranges, a row for each key and range, are scanned by key; then each row adds the total of its key's earlier ranges. Ranges
are numbered by partition and written to the shared folder first, as a number must outlive its task.

Defined cases: rows with equal keys and orders lie in one range and come in no certain order: name enough columns. Null
keys are one key. Nulls do not count in sums and extremes. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.lineage import cut

PART = "__part"


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range in PART; ranges follow (key, order)."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


#: About as many rows as a task holds that keeps tables of its rows.
TASK_ROWS = 250_000


def tasks(rows: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """So many tasks that one has about task_rows of the rows, however many there are; no fewer than Spark would take. Rows are counted."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // task_rows))


def dealt(rows: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt by keys to tasks of about task_rows."""
    return rows.repartition(tasks(rows, task_rows), *keys)


def _of_key(keys: Sequence[str]):
    """Earlier ranges of a key, over the rows of totals: as many as a key has ranges."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.col(f"r.{PART}") == F.col(f"t.{PART}")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    own = [F.col(f"t.{c}") for c in totals.columns if c not in (*keys, PART)]
    return rows.alias("r").join(totals.alias("t"), same).select("r.*", *own)


def running(dealt: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, sums: dict[str, str | Column] | None = None, most: dict[str, str | Column] | None = None) -> DataFrame:
    """Of ranged() rows: columns with the sum, or the largest value, of all rows of the key up to and with this one."""
    sums, most = {n: F.col(c) if isinstance(c, str) else c for n, c in (sums or {}).items()}, {n: F.col(c) if isinstance(c, str) else c for n, c in (most or {}).items()}
    here = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(*keys, PART).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], *[F.max(c).alias(f"__{n}") for n, c in most.items()])
    before = totals.select(*keys, PART, *[F.sum(f"__{n}").over(_of_key(keys)).alias(f"__{n}") for n in sums], *[F.max(f"__{n}").over(_of_key(keys)).alias(f"__{n}") for n in most])
    scanned = dealt.withColumns({**{f"__own_{n}": F.sum(c).over(here) for n, c in sums.items()}, **{f"__own_{n}": F.max(c).over(here) for n, c in most.items()}})
    met = _joined(scanned, before, keys)
    added = {n: F.when(F.col(f"__own_{n}").isNull(), F.col(f"__{n}")).otherwise(F.col(f"__own_{n}") + F.coalesce(F.col(f"__{n}"), F.lit(0))) for n in sums}
    larger = {n: F.greatest(f"__own_{n}", f"__{n}") for n in most}
    return met.withColumns({**added, **larger}).drop(*[f"__{n}" for n in (*sums, *most)], *[f"__own_{n}" for n in (*sums, *most)])


def previous(dealt: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, str]) -> DataFrame:
    """Of ranged() rows: columns with what the row before has, of its key; null for a key's first row."""
    here = Window.partitionBy(*keys, PART).orderBy(*order)
    held = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    place = F.struct(*order)
    ends = dealt.groupBy(*keys, PART).agg(F.max_by(held, place).alias("__end"))
    before = ends.select(*keys, PART, F.lag("__end").over(Window.partitionBy(*keys).orderBy(PART)).alias("__end"))
    met = _joined(dealt.withColumn("__held", F.lag(held).over(here)), before, keys)
    return met.select(*[F.col(c) for c in dealt.columns], *[F.coalesce("__held", "__end")[n].alias(n) for n in values])


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "n", keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The rows with their place from 1, in the whole table or within a key, without a window over either."""
    if keys:
        return running(ranged(rows, keys, order, parts), keys, order, sums={name: F.lit(1).cast("long")}).drop(PART)
    whole = rows.withColumn("__all", F.lit(0))
    return running(ranged(whole, [], order, parts), ["__all"], order, sums={name: F.lit(1).cast("long")}).drop(PART, "__all")


def trailing(rows: DataFrame, key: str, at: str, span: float, sums: dict[str, str]) -> DataFrame:
    """Sums over the rows of a key from `span` before a row up to it, rows at the same place included.

    Time is cut into cells of the span: a row's frame lies in its own cell and the one before, so each row stands in its
    cell and, as one that only counts, in the next. A hot key has as many tasks as cells.
    """
    cell = F.floor(F.col(at) / span)
    stands = F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("own"))))
    each = rows.withColumn("__s", stands).withColumns({"__cell": F.col("__s.cell"), "__own": F.col("__s.own")}).drop("__s")
    frame = Window.partitionBy(key, "__cell").orderBy(at).rangeBetween(-span, 0)
    return each.withColumns({n: F.sum(c).over(frame) for n, c in sums.items()}).where("__own").drop("__cell", "__own")


def peak_of(edges: DataFrame, key: str, order: Sequence[str | Column], delta: str, parts: int | None = None) -> DataFrame:
    """key and peak: the largest running sum of delta, 0 at least. Ranges give their total and their own peak, no row more."""
    dealt = ranged(edges, [key], order, parts)
    here = Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = dealt.withColumn("__open", F.sum(delta).over(here)).groupBy(key, PART).agg(F.sum(delta).alias("__total"), F.max("__open").alias("__top"))
    placed = tops.withColumn("__top", F.col("__top") + F.coalesce(F.sum("__total").over(_of_key([key])), F.lit(0)))
    return placed.groupBy(key).agg(F.greatest(F.max("__top"), F.lit(0)).alias("peak"))
