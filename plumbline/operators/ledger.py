"""The URL ledger: observations become distinct canonical URLs with provenance, and are counted.

Observations: url, title, channel, source_class, query_family, access_limited, ord (the order in which they were seen).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.urls import canonical_url, host_of


def canonicalised(observations: DataFrame, url: str = "url") -> DataFrame:
    """The observations with canonical_url (null: invalid) and domain."""
    return observations.withColumn("canonical_url", canonical_url(F.col(url))).withColumn("domain", host_of(F.col("canonical_url")))


def ledger(observations: DataFrame) -> DataFrame:
    """One row a canonical URL: what was seen first, and sorted distinct provenance of all sightings.

    One shuffle on the URL, with partial aggregates before it.
    """
    valid = canonicalised(observations).where(F.col("canonical_url").isNotNull())
    first = lambda c: F.min_by(c, "ord").alias(f"first_{c}")
    every = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return valid.groupBy("canonical_url", "domain").agg(first("url"), first("title"), F.count(F.lit(1)).alias("sightings"), every("channel"), every("source_class"), every("query_family"), F.bool_or("access_limited").alias("access_limited"))


def ledger_stats(observations: DataFrame) -> DataFrame:
    """One row: raw, valid, unique and duplicate sightings, domains, and limited URLs."""
    seen = canonicalised(observations).groupBy("canonical_url", "domain").agg(F.count(F.lit(1)).alias("n"), F.bool_or("access_limited").alias("limited"))
    valid = F.col("canonical_url").isNotNull()
    return seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid"),
        F.count("canonical_url").alias("unique"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.countDistinct("domain").alias("domains"),
        F.count(F.when(valid & F.col("limited"), 1)).alias("access_limited"),
    )


def provenance_counts(observations: DataFrame, column: str) -> DataFrame:
    """Distinct URLs of each value of a provenance column."""
    valid = canonicalised(observations).where(F.col("canonical_url").isNotNull())
    return valid.select(column, "canonical_url").distinct().groupBy(column).agg(F.count(F.lit(1)).alias("urls"))


def provenance_for(observations: DataFrame, url: str) -> DataFrame:
    """The ledger row of one URL, given in any of its spellings."""
    return ledger(observations).where(F.col("canonical_url") == canonical_url(F.lit(url)))


def channel_counts(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct products found through each channel. candidates: url_id, platform, product_id; routes: url_id, channel."""
    return candidates.join(routes, "url_id").groupBy("channel").agg(F.countDistinct("platform", "product_id").alias("candidates"))


def family_counts(cursors: DataFrame, batches: DataFrame) -> DataFrame:
    """Cursors of each query family: all, exhausted and blocked ones, and what they added."""
    joined = cursors.join(batches, cursors["last_batch_id"] == batches["batch_id"]).where(batches["complete"])
    return joined.groupBy("source", "query_family").agg(
        F.count(F.lit(1)).alias("cursors"),
        F.sum(F.when(F.col("status") == "exhausted", 1).otherwise(0)).alias("exhausted"),
        F.sum(F.when(F.col("status") == "blocked", 1).otherwise(0)).alias("blocked"),
        F.sum("unique_candidate_additions").alias("additions"),
    )


def field_coverage(rows: DataFrame, json_column: str, fields: tuple[str, ...]) -> DataFrame:
    """In how many rows each of the fields of a JSON object of strings is set; zero-filled, and `any` for at least one."""
    from plumbline.functions.jsonx import read_fields

    held = rows.select(read_fields(F.col(json_column), fields).alias("held"))
    names = F.array(*[F.lit(f) for f in fields], F.lit("any"))
    each = held.select(F.explode(F.when(F.size("held") > 0, F.array_append(F.map_keys("held"), F.lit("any"))).otherwise(F.map_keys("held"))).alias("field"))
    zero = held.sparkSession.range(1).select(F.explode(names).alias("field"))
    return zero.join(each.groupBy("field").agg(F.count(F.lit(1)).alias("n")), "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("rows"))


# What follows from each category of failure.
DISPOSITIONS = {
    "pagination_page_transient_empty": "retry_same_page",
    "pagination_page_stalled": "retry_same_page",
    "browser_page_structure_changed": "rotate_family",
    "pagination_session_missing": "rotate_family",
    "page_exhausted": "rotate_family",
    "authentication_required": "hard_block",
    "browser_authentication_required": "hard_block",
    "captcha_required": "hard_block",
    "browser_captcha_required": "hard_block",
    "rate_limited": "hard_block",
    "browser_rate_limited": "hard_block",
}


def with_disposition(failures: DataFrame, category: str = "category") -> DataFrame:
    """What to do about each failure; null for unknown categories."""
    names = F.create_map(*[F.lit(x) for pair in DISPOSITIONS.items() for x in pair])
    return failures.withColumn("disposition", F.try_element_at(names, F.col(category)))


def recovery_summary(failures: DataFrame) -> DataFrame:
    """Failures by disposition, family and category, with subtotals of each level (null below it)."""
    return with_disposition(failures).rollup("disposition", "query_family", "category").agg(F.count(F.lit(1)).alias("n"))


# The attempt that each stage of a recovery is, platforms and the most pages of a search.
STAGE_ATTEMPTS = {"initial": 0, "reproject": 1, "reload": 2}
PLATFORMS = ("jd", "taobao")
MOST_PAGES = 512
TEXT_BOUNDS = {"run_id": 256, "platform": 16, "query_family": 512, "recovery_stage": 16, "category": 64, "disposition": 32}


def recovery_faults() -> Column:
    """What is wrong with a recovery event (run_id, platform, query_family, page_number, recovery_stage, attempt, category, disposition)."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    names = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    fault = lambda ok, said: F.when(~F.coalesce(ok, F.lit(False)), F.lit(said))
    known = F.try_element_at(names(DISPOSITIONS), text("category"))
    return F.array_compact(
        F.array(
            *[fault((text(c) != "") & (F.length(text(c)) <= most), f"{c} is empty or too long") for c, most in TEXT_BOUNDS.items()],
            fault(F.lower(text("platform")).isin(*PLATFORMS), "unknown platform"),
            fault(F.col("page_number").between(1, MOST_PAGES), "page out of bounds"),
            fault(F.try_element_at(names(STAGE_ATTEMPTS), F.lower(text("recovery_stage"))) == F.col("attempt"), "attempt is not the stage's"),
            fault(known.isNotNull(), "unknown category"),
            F.when(known.isNotNull(), fault(known == text("disposition"), "disposition is not the category's")),
        )
    )


def append_recoveries(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known with the new events that hold the rules, platform and stage lower-cased and texts trimmed; and those refused, with faults."""
    judged = new.withColumn("faults", recovery_faults())
    clean = {c: F.trim(c) for c in TEXT_BOUNDS} | {c: F.lower(F.trim(c)) for c in ("platform", "recovery_stage")}
    return known.unionByName(judged.where(F.size("faults") == 0).withColumns(clean).select(*known.columns)), judged.where(F.size("faults") > 0)


def failure_histogram(failures: DataFrame) -> DataFrame:
    """category and n, in order of category; blank ones are left out."""
    named = F.trim(F.coalesce("category", F.lit("")))
    return failures.select(named.alias("category")).where("category != ''").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def failure_categories(failures: DataFrame) -> DataFrame:
    return failures.select("category").distinct().orderBy("category")


def append_failures(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and the new failures whose digest of category and parameters it does not hold, each once."""
    from plumbline.functions.hashing import short_hash

    marked = new.withColumn("failure_id", short_hash(F.col("batch_id"), F.col("category"), F.col("parameter_digest"))).dropDuplicates(["failure_id"])
    return known.unionByName(marked.join(known.select("failure_id"), "failure_id", "left_anti"), allowMissingColumns=True)
