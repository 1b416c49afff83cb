"""Upserts, insert-or-ignore, merges and deletions with an audit. `ord` is the order in which changes came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """existing and the first new row of each key that it does not have."""
    first = Window.partitionBy(*key).orderBy(order)
    once = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return existing.unionByName(once.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """existing with the last change of each key: one shuffle, the largest struct of a key wins."""
    fields = [c for c in existing.columns if c not in key]
    tagged = existing.select(*key, F.struct(F.lit(0).alias("late"), F.lit(None).cast(dict(changes.dtypes)[order]).alias("at"), *fields).alias("row"))
    new = changes.select(*key, F.struct(F.lit(1).alias("late"), F.col(order).alias("at"), *fields).alias("row"))
    return tagged.unionByName(new).groupBy(*key).agg(F.max("row").alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in fields])


def upsert_with_history(pool: DataFrame, changes: DataFrame, key: str, pinned: list[str]) -> DataFrame:
    """pool (key, fields, status, history) with changes: a change of a pinned field sets the status back and is put down."""
    fields = [c for c in changes.columns if c != key]
    joined = pool.join(changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields]), F.col(key) == F.col("__key"), "full_outer")
    both = F.col("__key").isNotNull() & F.col(key).isNotNull()
    moved = F.lit(False)
    for c in pinned:
        moved = moved | (both & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    entry = F.struct(F.col("status").alias("status"), F.to_json(F.struct(*[F.col(c) for c in pinned])).alias("was"))
    return joined.select(
        F.coalesce(F.col(key), F.col("__key")).alias(key),
        *[F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col(key).isNull() | moved, "pending").otherwise(F.col("status")).alias("status"),
        F.when(moved, F.array_append("history", entry)).otherwise(F.coalesce("history", F.array().cast(dict(pool.dtypes)["history"]))).alias("history"),
    )


def delete_with_audit(rows: DataFrame, removals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without removed keys, and an audit row (key, evidence, found) of each removal; a removal without evidence has no effect."""
    proven = removals.where(F.size("evidence") > 0)
    audit = proven.join(rows.select(key, F.lit(True).alias("found")), key, "left").select(key, "evidence", F.coalesce("found", F.lit(False)).alias("found"))
    return rows.join(proven.select(key), key, "left_anti"), audit


def merge_objects(known: DataFrame, new: DataFrame, key: str = "object_id") -> DataFrame:
    """Both, by key: evidence URLs united, later non-null fields first. Columns: key, evidence_urls and others."""
    fields = [c for c in known.columns if c not in (key, "evidence_urls")]
    joined = known.join(new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("evidence_urls", *fields)]), F.col(key) == F.col("__key"), "full_outer")
    none = F.array().cast("array<string>")
    return joined.select(F.coalesce(F.col(key), F.col("__key")).alias(key), F.array_sort(F.array_union(F.coalesce("evidence_urls", none), F.coalesce("__evidence_urls", none))).alias("evidence_urls"), *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in fields])


def fill_blank(keep: Column, other: Column) -> Column:
    """other if it says something, else keep."""
    return F.coalesce(F.nullif(other, F.lit("")), keep)


def merge_parents(pairs: DataFrame, fields: list[str], protected: list[str]) -> DataFrame:
    """keep and source records of (keep, source) struct pairs as one: what the source says wins but for protected fields; lists are united."""
    lists = [f for f in ("tags", "collections") if f in pairs.schema["keep"].dataType.names]
    return pairs.select(
        F.struct(
            *[(F.col(f"keep.{f}") if f in protected else fill_blank(F.col(f"keep.{f}"), F.col(f"source.{f}"))).alias(f) for f in fields],
            *[F.array_union(f"keep.{f}", f"source.{f}").alias(f) for f in lists],
        ).alias("merged")
    ).select("merged.*")


def union_by(left: Column, right: Column, key: str) -> Column:
    """Two arrays of structs as one: of equal keys the first stays."""
    return F.concat(left, F.filter(right, lambda r: ~F.exists(left, lambda x: x[key] == r[key])))


def review(pool: DataFrame, decisions: DataFrame, key: str = "id", allowed: tuple[str, ...] = ("adopted", "rejected", "deferred")) -> DataFrame:
    """pool (key, status, history) after decisions (key, status, evidence): an adoption needs evidence; others are refused as a whole."""
    right = decisions.select(F.col(key), F.col("status").alias("__to"), "evidence")
    joined = pool.join(right, key, "left")
    bad = F.col("__to").isNotNull() & (~F.col("__to").isin(*allowed) | ((F.col("__to") == "adopted") & (F.coalesce("evidence", F.lit("")) == "")))
    status = F.when(bad, F.raise_error(F.concat(F.lit("no such review: "), F.col(key))).cast("string")).otherwise(F.coalesce("__to", "status"))
    entry = F.struct(F.col("status").alias("status"), F.lit("{}").alias("was"))
    return joined.select(*[c for c in pool.columns if c not in ("status", "history")], status.alias("status"), F.when(F.col("__to").isNotNull(), F.array_append("history", entry)).otherwise(F.col("history")).alias("history"))


def freeze_batch(index: DataFrame, cards: DataFrame, batch: str, day: str) -> DataFrame:
    """index rows of a batch with the tags of their cards (logical_id, tags), the day and status set; others as they are."""
    right = cards.select("logical_id", F.col("tags").alias("__tags"))
    joined = index.join(right, "logical_id", "left")
    mine = F.col("batch_id") == batch
    return joined.select(*[c for c in index.columns if c not in ("tags", "verified_at", "status")], F.when(mine, F.coalesce("__tags", "tags")).otherwise(F.col("tags")).alias("tags"), F.when(mine, F.lit(day)).otherwise(F.col("verified_at")).alias("verified_at"), F.when(mine, "frozen").otherwise(F.col("status")).alias("status"))
