"""Evidence as entity, field and value: lossless grouping, progress and decisions over recorded telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_TARGET = 50.0
SEARCH_LIMIT = 600.0
BULK_KINDS = ("dataset", "bulk_api", "sitemap", "url_index")
# States of a source that block it.
BLOCKING = ("blocked", "captcha", "authentication_required", "rate_limited", "cooling")


def atoms(rows: DataFrame, entity: list[str], fields: list[str]) -> DataFrame:
    """A row for each field of each entity: entity, field, value (as text) and ord; one pass over the rows."""
    pair = lambda f, i: F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(i).alias("ord"))
    return rows.select(F.concat_ws(":", *[F.col(c).cast("string") for c in entity]).alias("entity"), F.explode(F.array(*[pair(f, i) for i, f in enumerate(fields)])).alias("it")).select("entity", "it.*")


def by_entity(rows: DataFrame) -> DataFrame:
    """entity, field and atoms: all values in order, none lost."""
    return rows.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("atoms"))


def fields_by_entity(rows: DataFrame, entity: list[str], fields: list[str]) -> DataFrame:
    """by_entity() of atoms(), with each row moved once as it is, not a text for each of its fields."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in entity]).alias("entity")
    held = rows.select(key, F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)]).alias("row")).repartition("entity").groupBy("entity").agg(F.collect_list("row").alias("rows"))
    atom = lambda i: F.array_sort(F.transform("rows", lambda r: F.struct(F.lit(i).alias("ord"), r[f"v{i}"].cast("string").alias("value"))))
    return held.select("entity", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), atom(i).alias("atoms")) for i, f in enumerate(fields)])).alias("it")).select("entity", "it.*")


def snapshot(rows: DataFrame) -> DataFrame:
    """entity and a map of its fields to their values in order."""
    return by_entity(rows).groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.transform("atoms", lambda a: a["value"]).alias("values"))))).alias("fields"))


def _first(*rules) -> Column:
    """The value of the first rule (test, value) that holds; the last has no test."""
    *tested, (_, last) = rules
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), reversed(tested), last)


def rate(count: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(count.cast("double"), seconds), F.lit(0.0))


def throughput_route(rows: DataFrame) -> DataFrame:
    """The next route of each run. Columns: discovery_seconds, batches, raw, recent_seconds, recent_raw, backends (name, kind, available, attempted)."""
    raw, recent = rate(F.col("raw"), F.col("discovery_seconds")), rate(F.col("recent_raw"), F.col("recent_seconds"))
    bulk = F.filter("backends", lambda b: b["available"] & b["kind"].isin(*BULK_KINDS))
    unused = F.array_sort(F.transform(F.filter(bulk, lambda b: ~b["attempted"]), lambda b: F.struct(F.lower(F.trim(b["name"])).alias("key"), b["name"].alias("name"))))
    warm, met = (F.col("discovery_seconds") < 5) | (F.col("batches") < 2), (raw >= RAW_TARGET) & (recent >= RAW_TARGET)
    say = lambda action, reason, backend=None: F.struct(F.lit(action).alias("action"), (F.lit(None).cast("string") if backend is None else backend).alias("backend"), F.lit(reason).alias("reason"))
    decision = _first((warm, say("continue", "warmup")), (met, say("continue", "target-met")), (F.size(unused) > 0, say("add_bulk_backend", "below-target-add-bulk-backend", F.get(unused, F.lit(0))["name"])), (F.size(bulk) > 0, say("switch_query_family", "bulk-backends-exhausted")), (None, say("search_only_degraded", "bulk-backend-unavailable")))
    return rows.withColumn("raw_rate", raw).withColumn("recent_rate", recent).withColumn("must_disclose", ~warm & ~met & (F.col("discovery_seconds") >= 15)).withColumn("decision", decision).select("*", "decision.*").drop("decision")


def scope_complete() -> Column:
    """Whether a bounded scope is done. Columns of `scope` and source_states (map)."""
    s = F.col("scope")
    calm = ~F.exists(F.map_values("source_states"), lambda v: v.isin(*BLOCKING))
    added = s["recent_candidate_additions"]
    few = F.aggregate(F.slice(added, 1, 3), F.lit(0).cast("long"), lambda acc, x: acc + x) <= 1
    return F.coalesce(calm & s["query_generation_exhausted"] & (s["healthy_cursors_open"] == 0) & (s["healthy_cursors_blocked"] == 0) & s["edge_plan_completed"] & (~s["api_available"] | s["api_cursor_completed"]) & (F.size(added) >= 3) & few & (s["untried_high_yield_families"] == 0), F.lit(False))


def marketplace_state(rows: DataFrame, *, window: float = 30.0, target: float = 10.0, least: int = 6000, limit: float = SEARCH_LIMIT, slow_lane: bool = False) -> DataFrame:
    """State, next action and acceptance of each run from its totals. The slow lane has wider windows and smaller targets."""
    wide, aim, minimum = (3 * window, 1.0, 60) if slow_lane else (window, target, least)
    seconds = F.col("wall_elapsed_seconds") if slow_lane else F.col("discovery_seconds")
    recent, average = F.col("recent_window_candidates") / wide, rate(F.col("total_unique_candidates"), seconds)
    duplicates = F.when(F.col("raw_observations") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("total_unique_candidates"), F.col("raw_observations"))))
    blocked = F.exists(F.map_values("source_states"), lambda v: v.isin(*BLOCKING))
    say = lambda state, action: F.struct(F.lit(state).alias("state"), F.lit(action).alias("next_action"))
    decision = _first(
        (seconds >= limit, say("ten_minute_limit", "stop_time_limit")), (scope_complete(), say("deterministic_scope_complete", "stop_scope_complete")),
        (F.col("max_zero_gap_seconds") >= wide, say("zero_window", "expand_query_family" if slow_lane else "switch_source")), (blocked, say("source_blocked", "cool_blocked_source")),
        (seconds < wide, say("warmup", "keep_routes")), ((duplicates >= 0.9) & (recent < aim), say("duplicate_saturation", "change_route_shape")), (recent < aim, say("slow", "expand_query_family")), (None, say("healthy", "keep_routes")),
    )
    accepted = (seconds >= limit) & (F.col("total_unique_candidates") >= minimum) & (F.lit(slow_lane) | (average >= aim)) & (F.col("max_zero_gap_seconds") < wide)
    return rows.withColumn("d", decision).select("*", "d.*", recent.alias("recent_per_second"), average.alias("average_per_second"), duplicates.alias("duplicate_rate"), accepted.alias("acceptance_passed")).drop("d")


def coverage_ready() -> Column:
    """Whether all that applies was tried and no gap is open."""
    tried = F.size(F.array_except(F.transform("applicable", lambda x: F.lower(F.trim(x))), F.transform("attempted", lambda x: F.lower(F.trim(x))))) == 0
    gaps = F.size(F.flatten(F.array("region_gaps", "language_gaps", "time_gaps", "platform_gaps"))) == 0
    return (F.size("applicable") > 0) & tried & gaps & ~F.col("domain_concentrated") & F.col("unlikely_to_change")


def stop_reason(seconds: Column, saturated: Column, sources_done: Column, coverage: Column, limit: float = SEARCH_LIMIT) -> Column:
    """Why discovery may stop; null if it goes on. Volumes play no part."""
    return F.when(seconds >= limit, "ten-minute-search-limit").when(saturated & sources_done & coverage, "search-saturated")


def global_status(marketplace: Column, enabled: Column, stop: Column, scope_done: Column, has_work: Column) -> Column:
    """The status of a run, by precedence."""
    return (
        F.when((marketplace == "ten_minute_limit") | (stop == "ten-minute-search-limit"), "ten_minute_limit")
        .when(marketplace == "deterministic_scope_complete", "deterministic_scope_complete")
        .when(enabled, F.when(has_work, "running").otherwise("incomplete_blocked"))
        .when(scope_done, "deterministic_scope_complete")
        .when(stop == "search-saturated", "search_saturated")
        .when(has_work, "running")
        .otherwise("incomplete_blocked")
    )


def progress(rows: DataFrame) -> DataFrame:
    """One row of totals and rates with the faults of their order: raw >= valid >= unique >= domains, and sources add up to raw."""
    total = rows.agg(*[F.sum(c).alias(c) for c in ("raw", "valid", "unique", "domains", "source_sum")], F.max("seconds").alias("seconds"))
    fault = lambda test, text: F.when(test, F.lit(text))
    return total.select("*", rate(F.col("raw"), F.col("seconds")).alias("raw_rate"), F.array_compact(F.array(fault(F.col("valid") > F.col("raw"), "valid exceeds raw"), fault(F.col("unique") > F.col("valid"), "unique exceeds valid"), fault(F.col("domains") > F.col("unique"), "domains exceed unique"), fault(F.col("source_sum") != F.col("raw"), "sources do not add up"))).alias("faults"))


def state_v2(states: DataFrame, folder: str, limit_seconds: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """States of the first schema in the second one, and those that can't be migrated with the reason.

    states: schema_version, run_id, run_kind and others. A market discovery becomes open research, any other run a quick one;
    the limit and the ledger's path are set, completion and generation are open, and addresses leave the state.
    """
    reason = F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "not of the first schema").when(F.trim(F.coalesce("run_id", F.lit(""))) == "", "run_id is empty")
    judged = states.withColumn("reason", reason)
    made = {
        "schema_version": F.lit(2),
        "run_type": F.when(F.col("run_kind") == "market_discovery", "open_web_research").otherwise("quick_direct"),
        "search_limit_seconds": F.lit(limit_seconds),
        "scope_completion": F.lit(None).cast("string"),
        "query_generation": F.lit(None).cast("string"),
        "peak_inflight": F.lit(0),
        "ledger_path": F.concat(F.lit(folder.rstrip("/") + "/"), F.trim("run_id"), F.lit(".sqlite")),
    }
    return judged.where("reason is null").withColumns(made).drop("reason", "canonical_urls"), judged.where("reason is not null")
