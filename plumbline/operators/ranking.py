"""Scores, gates and rankings; query products addressed by number."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights of a direction's dimensions.
WEIGHTS = {"recommendation": 0.05, "prospect": 0.15, "feasibility": 0.25, "venue_fit": 0.10, "uniqueness": 0.25, "evidence": 0.05, "learning_fit": 0.15}
REJECT_TRAINING = ("over_budget", "multi_gpu_only", "unbounded")
REJECT_DEPLOYMENT = ("above_jetson", "special_hardware", "large_memory_model")
UNKNOWN = ("", "unknown", "not_measured", "unverified")
MOST_RANKED = 15


def direction_score(dimensions: Column) -> Column:
    """The weighted sum of a map's known dimensions, to two digits."""
    return F.round(sum((F.coalesce(F.try_element_at(dimensions, F.lit(n)), F.lit(0.0)) * w for n, w in WEIGHTS.items()), F.lit(0.0)), 2)


def direction_gate() -> Column:
    """reasons against a direction, and whether one of them rejects it (the others leave it to be checked)."""
    training, deployment = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("unknown")))) for c in ("training_budget_status", "deployment_status"))
    reason = lambda test, text, rejects: F.when(test, F.struct(F.lit(text).alias("reason"), F.lit(rejects).alias("rejects")))
    found = F.array_compact(
        F.array(
            reason(~F.coalesce(F.col("hard_gate"), F.lit(False)), "topic gate failed", True),
            reason(training.isin(*REJECT_TRAINING), "training budget exceeded", True),
            reason(training.isin(*UNKNOWN), "training budget unverified", False),
            reason(deployment.isin(*REJECT_DEPLOYMENT), "deployment exceeds limit", True),
            reason(deployment.isin(*UNKNOWN), "deployment unverified", False),
            reason(F.coalesce(F.col("generic_topic"), F.lit(False)), "generic topic", True),
        )
    )
    return F.struct(F.transform(found, lambda r: r["reason"]).alias("reasons"), (~F.exists(found, lambda r: r["rejects"])).alias("accepted"))


def rank_directions(rows: DataFrame, limit: int = MOST_RANKED) -> DataFrame:
    """Accepted directions by falling score, then name."""
    gated = rows.withColumn("gate", direction_gate()).where("gate.accepted").withColumn("score", direction_score(F.col("dimensions")))
    return gated.select(*rows.columns, "score", F.col("gate.reasons").alias("reasons"), F.when(F.size("gate.reasons") > 0, "pending").otherwise("passed").alias("preference")).orderBy(F.desc("score"), "name").limit(max(0, min(limit, MOST_RANKED)))


def task_score(metrics: Column, gaps_covered: Column) -> Column:
    """A task's worth: yields and diversity for it, duplicates, failures, concentration and cost against it."""
    of = lambda name, default=0.0: F.coalesce(F.try_element_at(metrics, F.lit(name)), F.lit(default))
    gain = 100 * of("object_yield") + 40 * of("canonical_yield") + 20 * gaps_covered + 10 * of("source_diversity", 1.0) + F.least(F.lit(10.0), of("raw_rate") / 50)
    return gain - 30 * of("duplicate_rate") - 40 * of("failure_rate") - 30 * of("domain_concentration") - 10 * of("access_cost")


def yields(seconds: Column, raw: Column, unique: Column, objects: Column) -> Column:
    """The metrics that a batch adds to its task."""
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), raw), F.lit(0.0))
    return F.create_map(F.lit("raw_rate"), F.coalesce(F.try_divide(raw.cast("double"), seconds), F.lit(0.0)), F.lit("canonical_yield"), share(unique), F.lit("object_yield"), share(objects), F.lit("duplicate_rate"), F.when(raw == 0, 0.0).otherwise(1 - share(unique)), F.lit("failure_rate"), F.lit(0.0))


def diverse_top(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows, the best of each group before any second one; `place` is a row's rank in its group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).orderBy(F.when(F.col("place") == 1, 0).otherwise(1), *order).limit(k)


def fair_order(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Rows with their turn when groups take turns: first the first rows of all groups, then the second ones."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).orderBy("turn", *groups)


def batch(rows: DataFrame, order: str, after: int | None, size: int) -> tuple[DataFrame, DataFrame]:
    """The next rows after a key, and one row telling whether they are the last: one row more is read than returned."""
    ahead = (rows if after is None else rows.where(F.col(order) > after)).orderBy(order).limit(size + 1)
    return ahead.orderBy(order).limit(size), ahead.agg((F.count(F.lit(1)) <= size).alias("exhausted"))


def product_size(axes: list[list[str]]) -> int:
    return prod(max(1, len(a)) for a in axes)


def product(spark: SparkSession, axes: dict[str, list[str]], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of the product of axes by number, the last axis fastest; only the numbers asked for are made, without a join."""
    lists = [v or [""] for v in axes.values()]
    total = product_size(lists)
    end = total if limit is None else min(total, offset + limit)
    rows, below = spark.range(offset, max(offset, end)).withColumnRenamed("id", "ordinal"), total
    for name, values in zip(axes, lists, strict=True):
        below //= len(values)
        rows = rows.withColumn(name, F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(F.col("ordinal") / below), F.lit(len(values))).cast("int")))
    return rows


def query_text(parts: list[Column], exclusions: list[str] = ()) -> Column:
    """Parts that are not blank, and excluded terms after a minus, by single spaces."""
    clean = [F.nullif(F.trim(p), F.lit("")) for p in parts]
    return F.concat_ws(" ", *clean, *[F.lit(f"-{e.strip()}") for e in exclusions if e.strip()])


def query_matrix(spark: SparkSession, axes: dict[str, list[str]], exclusions: list[str] = ()) -> DataFrame:
    """Distinct queries of a product in order of first making."""
    unique = {name: list(dict.fromkeys(v)) for name, v in axes.items()}
    made = product(spark, unique).select("ordinal", query_text([F.col(c) for c in unique], exclusions).alias("query")).where("query != ''")
    return made.groupBy("query").agg(F.min("ordinal").alias("ordinal"))


def cursors(rows: DataFrame, platform: str, query: str) -> DataFrame:
    """Rows with a cursor id made of platform, number and query."""
    identity = F.concat_ws("\0", F.col(platform), F.col("ordinal").cast("string"), F.col(query))
    return rows.withColumn("cursor_id", F.concat(F.col(platform), F.lit(":"), F.substring(F.sha2(identity, 256), 1, 20)))


def page_tasks(cursor_rows: DataFrame, pages: list[int]) -> DataFrame:
    """Each cursor for each page, in order of cursor, then page."""
    return cursor_rows.withColumn("page_number", F.explode(F.array(*map(F.lit, pages))))


def query_families(topic: Column, suffixes: tuple[str, ...]) -> Column:
    """The topic, and the topic with each suffix, each once."""
    return F.array_distinct(F.concat(F.array(topic), F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.trim(F.concat(topic, F.lit(" "), s)))))


def expand_seeds(seeds: DataFrame, seen: DataFrame, existing: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Queries of seeds not seen before, without those that exist."""
    new = seeds.select("seed").distinct().join(seen, "seed", "left_anti")
    return new.select("seed", F.explode(query_families(F.col("seed"), suffixes)).alias("query")).join(existing, "query", "left_anti")


def nice_ceiling(value: Column) -> Column:
    """The least of 1, 2, 4, 5, 8, 10 times a power of ten that is not below a value; 1 for values up to 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(value > 0, value))))
    steps = F.transform(F.array(*map(F.lit, (1.0, 2.0, 4.0, 5.0, 8.0, 10.0))), lambda f: f * power)
    return F.when(value <= 0, F.lit(1)).otherwise(F.array_min(F.filter(steps, lambda s: s >= value))).cast("long")
