"""Capturing and resolving problems over three tables that change together: families, solutions and events.

Each operator takes the tables and a batch of requests and gives all tables anew, with the faults of what it refused; the
caller commits them as one version (sources.versions), so that no reader sees an event whose solution is not there yet.
A catalog of families and solutions is authority: its families join the tables when a problem first shows them, its verified
solutions as references (catalog_source = builtin).

families: family_id, component, operation, failure_phase, error_class, feature_groups, any_features, solution_ids
solutions: solution_id, family_id, catalog_source, status, guard, steps, reuse_success_count, reuse_failure_count, source_legacy_ids
events: event_id, legacy_id, component, symptom_signature, environment (map), family_id, confidence, candidates, solution_id, status,
        root_cause, verification, first_seen, last_seen, occurrences

Defined cases: an empty batch changes nothing. Requests for one problem in one batch act in order of ord. Null maps are
empty ones. Requests that are refused leave all tables as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import short_hash
from plumbline.operators import registry, scan

IDENTITY = ("operation", "failure_phase", "error_class")

# Requests that one copy of their component's list of families is joined to.
LIST_ROWS = 5_000


def merged_catalog(families: DataFrame, catalog: DataFrame) -> DataFrame:
    """Families of the catalog, and those of the tables that it lacks."""
    return catalog.select(*families.columns).unionByName(families.join(catalog.select("family_id"), "family_id", "left_anti").select(*families.columns))


def _environment(column: str = "environment") -> Column:
    return F.coalesce(column, F.create_map().cast("map<string,string>"))


def problem_key(component: Column, symptom: Column, environment: Column) -> Column:
    """What makes two reports one problem: component, signature and environment, as one string."""
    return F.concat_ws("\u001f", registry.component_name(component), registry.signature(symptom), registry.scope_json(environment))


def event_id(component: Column, symptom: Column, environment: Column) -> Column:
    return F.concat(F.lit("event."), short_hash(registry.component_name(component), registry.signature(symptom), registry.scope_json(environment)))


def with_references(families: DataFrame, solutions: DataFrame, hit: DataFrame, catalog_families: DataFrame, catalog_solutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the catalog's families that are hit (family_id) and references to their verified solutions."""
    taken = catalog_families.join(hit.select("family_id").distinct(), "family_id", "left_semi")
    more = taken.join(families.select("family_id"), "family_id", "left_anti").select(*families.columns)
    named = taken.select("family_id", F.explode("solution_ids").alias("solution_id"))
    known = catalog_solutions.where("status = 'verified'").join(named, ["solution_id", "family_id"], "left_semi").join(solutions.select("solution_id"), "solution_id", "left_anti")
    none = {f.name: F.lit(None).cast(f.dataType) for f in solutions.schema.fields}
    zero = F.lit(0).cast(solutions.schema["reuse_success_count"].dataType)
    own = none | {"solution_id": F.col("solution_id"), "family_id": F.col("family_id"), "status": F.lit("verified"), "catalog_source": F.lit("builtin"), "reuse_success_count": zero, "reuse_failure_count": zero, "source_legacy_ids": F.array().cast("array<string>")}
    return families.unionByName(more), solutions.unionByName(known.select(*[own[c].alias(c) for c in solutions.columns]))


def capture(families: DataFrame, solutions: DataFrame, events: DataFrame, requests: DataFrame, catalog_families: DataFrame, catalog_solutions: DataFrame) -> dict[str, DataFrame]:
    """All tables after reports of problems (request_id, ord, component, symptom, named, operation, failure_phase,
    error_class, environment, at).

    A report is classified against tables and catalog. A new problem becomes an event with the only verified solution of its
    family; a known one counts on. Its family follows the last report that has one; its solution too, if it had none or a
    report named another family.
    """
    asked = requests.withColumn("environment", _environment())
    told = registry.classify(asked.select(F.col("request_id").alias("event_id"), "component", "symptom", "named", *IDENTITY), merged_catalog(families, catalog_families)).withColumnRenamed("event_id", "request_id")
    families, solutions = with_references(families, solutions, told.where("family_id is not null"), catalog_families, catalog_solutions)
    verified = solutions.where("status = 'verified'").groupBy("family_id").agg(F.count(F.lit(1)).alias("__n"), F.first("solution_id").alias("__sid")).where("__n = 1").drop("__n")

    key = problem_key(F.col("component"), F.col("symptom"), F.col("environment"))
    rows = asked.join(told, "request_id").withColumn("__key", key)
    clear = lambda c: F.max_by(F.when(F.col("family_id").isNotNull(), F.col(c)), F.when(F.col("family_id").isNotNull(), F.col("ord")))
    batch = rows.groupBy("__key").agg(
        F.first(registry.component_name(F.col("component"))).alias("__component"),
        F.first(registry.signature(F.col("symptom"))).alias("__signature"),
        F.first(registry.scope_json(F.col("environment"))).alias("__scope"),
        F.first(event_id(F.col("component"), F.col("symptom"), F.col("environment"))).alias("__id"),
        clear("family_id").alias("__family"), clear("confidence").alias("__sure"), clear("candidates").alias("__candidates"),
        F.collect_set("family_id").alias("__families"),
        F.max_by("confidence", "ord").alias("__last_sure"), F.max_by("candidates", "ord").alias("__last_candidates"),
        F.min("at").alias("__first"), F.max("at").alias("__last"), F.count(F.lit(1)).alias("__times"),
    )
    batch = batch.join(verified.withColumnRenamed("family_id", "__family"), "__family", "left")
    held = events.withColumn("__key", problem_key(F.col("component"), F.col("symptom_signature"), _environment()))
    kinds = {f.name: f.dataType for f in events.schema.fields}

    fresh = batch.join(held.select("__key"), "__key", "left_anti")
    none = F.array().cast("array<string>")
    made = {
        "event_id": F.col("__id"), "legacy_id": F.concat(F.lit("native-v3:"), "__id"), "component": F.col("__component"), "symptom_signature": F.col("__signature"),
        "environment": F.from_json("__scope", "map<string,string>"), "family_id": F.coalesce("__family", F.concat(F.lit("unclassified."), F.coalesce(F.nullif("__component", F.lit("")), F.lit("unknown")), F.lit("."), short_hash(F.coalesce(F.nullif("__component", F.lit("")), F.lit("unknown")), F.col("__signature")))),
        "confidence": F.coalesce("__sure", "__last_sure"), "candidates": F.coalesce("__candidates", "__last_candidates", none), "solution_id": F.col("__sid"), "status": F.lit("observed"),
        "root_cause": F.lit("unconfirmed"), "verification": F.lit("not-yet-verified"), "first_seen": F.col("__first"), "last_seen": F.col("__last"), "occurrences": F.col("__times"),
    }
    new = fresh.select(*[made[c].cast(kinds[c]).alias(c) for c in events.columns])

    # Compared before the select below, where a lambda's family_id would be the new one.
    seen = held.join(batch, "__key", "left").withColumns({"__here": F.col("__times").isNotNull(), "__other": F.exists("__families", lambda f: f != F.col("family_id"))})
    has, loose = F.col("__family").isNotNull(), F.col("family_id").startswith("unclassified.")
    after = {
        "family_id": F.when(has, F.col("__family")).otherwise(F.col("family_id")),
        "confidence": F.when(has, F.col("__sure")).when(F.col("__here") & loose, F.col("__last_sure")).otherwise(F.col("confidence")),
        "candidates": F.when(has, F.col("__candidates")).when(F.col("__here") & loose, F.col("__last_candidates")).otherwise(F.col("candidates")),
        "solution_id": F.when(has & (F.col("solution_id").isNull() | F.col("__other")), F.col("__sid")).otherwise(F.col("solution_id")),
        "last_seen": F.coalesce("__last", "last_seen"),
        "occurrences": F.col("occurrences") + F.coalesce("__times", F.lit(0)),
    }
    old = seen.select(*[(after[c].cast(kinds[c]) if c in after else F.col(c)).alias(c) for c in events.columns])
    return {"families": families, "solutions": solutions, "events": old.unionByName(new)}


def resolution_faults(families: DataFrame, solutions: DataFrame, events: DataFrame, asked: DataFrame, catalog_families: DataFrame, catalog_solutions: DataFrame) -> DataFrame:
    """request_id and fault: the first thing against each request to resolve an event, of those that have one."""
    known = events.select(F.explode(F.array_distinct(F.array("event_id", "legacy_id"))).alias("event_id"), F.col("component").alias("__component"))
    every = merged_catalog(families, catalog_families).select(registry.component_name(F.col("component")).alias("__fc"), "family_id", *IDENTITY)
    owners = every.select(F.col("family_id").alias("__owner"), F.col("__fc").alias("__component"), *[F.trim(c).alias(f"__{c}") for c in IDENTITY])
    rows = asked.join(known, "event_id", "left").withColumn("__component", registry.component_name(F.col("__component")))
    rows = rows.withColumns({f"__{c}": F.trim(c) for c in IDENTITY}).join(owners, ["__component", *[f"__{c}" for c in IDENTITY]], "left")
    rows = rows.join(catalog_solutions.select("solution_id", F.lit(True).alias("__reserved")), "solution_id", "left")
    rows = rows.join(every.select("family_id", F.col("__fc").alias("__owned"), *[F.col(c).alias(f"__is_{c}") for c in IDENTITY]), "family_id", "left")
    rows = rows.join(solutions.select("solution_id", F.col("catalog_source").alias("__source"), F.col("family_id").alias("__sf")), "solution_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = F.lit(False)
    for c in ("family_id", "solution_id", *IDENTITY, "root_cause", "verification"):
        empty = empty | blank(c)
    fault = (
        F.when(empty, "a field is empty")
        .when(F.size(F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda s: F.trim(s) != "")) == 0, "no steps")
        .when(blank("expected_effect"), "no expected effect")
        .when(F.col("domain_semantics") & blank("regression_test"), "no regression test")
        .when(F.col("__component").isNull() | (F.col("__component") == ""), "unknown event")
        .when(F.col("__owner").isNotNull() & (F.col("__owner") != F.col("family_id")), "identity belongs to another family")
        .when(F.col("__reserved"), "solution is reserved by the catalog")
        .when(F.col("__owned").isNotNull() & (F.col("__owned") != F.col("__component")), "family of another component")
    )
    for c in IDENTITY:
        fault = fault.when(F.col("__owned").isNotNull() & (F.col(f"__is_{c}") != F.col(f"__{c}")), f"family differs in {c}")
    fault = fault.when(F.col("__source") == "builtin", "reference to the catalog").when(F.col("__sf") != F.col("family_id"), "solution of another family")
    return rows.groupBy("request_id").agg(F.min(fault).alias("fault")).where("fault is not null")


def resolve(families: DataFrame, solutions: DataFrame, events: DataFrame, requests: DataFrame, catalog_families: DataFrame, catalog_solutions: DataFrame) -> dict[str, DataFrame]:
    """All tables after events are resolved, and `faults` of the requests that were refused.

    requests: request_id, ord, event_id (or legacy id), family_id, solution_id, operation, failure_phase, error_class, root_cause,
    verification, steps, guard, expected_effect, domain_semantics, regression_test, at. The last request of an event, of a
    solution and of a new family counts.
    """
    faults = resolution_faults(families, solutions, events, requests, catalog_families, catalog_solutions)
    good = requests.join(faults.select("request_id"), "request_id", "left_anti")
    named = events.select(F.explode(F.array_distinct(F.array("event_id", "legacy_id"))).alias("__asked"), F.col("event_id").alias("__event"), F.col("legacy_id").alias("__legacy"), F.col("component").alias("__component"))
    good = good.join(named, F.col("event_id") == F.col("__asked"))
    families, solutions = with_references(families, solutions, good, catalog_families, catalog_solutions)

    kinds = {f.name: f.dataType for f in families.schema.fields}
    first = good.groupBy("family_id").agg(*[F.max_by(c, "ord").alias(c) for c in ("__component", *IDENTITY)])
    made = {"family_id": F.col("family_id"), "component": registry.component_name(F.col("__component")), **{c: F.trim(c) for c in IDENTITY}, "feature_groups": F.array(), "any_features": F.array(), "solution_ids": F.array()}
    families = families.unionByName(first.join(families.select("family_id"), "family_id", "left_anti").select(*[made[c].cast(kinds[c]).alias(c) for c in families.columns]))
    more = good.groupBy("family_id").agg(F.collect_set("solution_id").alias("__more"))
    families = families.join(more, "family_id", "left").withColumn("solution_ids", F.when(F.col("__more").isNotNull(), F.array_sort(F.array_union(F.coalesce("solution_ids", F.array().cast("array<string>")), "__more"))).otherwise(F.col("solution_ids"))).drop("__more").select(*families.columns)

    last = good.groupBy("solution_id").agg(F.max_by(F.struct("family_id", "steps", "guard"), "ord").alias("__it"), F.array_sort(F.collect_set("__legacy")).alias("__legacies"))
    was = solutions.select("solution_id", F.col("reuse_success_count").alias("__s"), F.col("reuse_failure_count").alias("__f"), F.col("source_legacy_ids").alias("__ids"))
    of = {f.name: f.dataType for f in solutions.schema.fields}
    clean = F.filter(F.transform("__it.steps", lambda s: F.trim(s)), lambda s: s != "")
    row = {"solution_id": F.col("solution_id"), "family_id": F.col("__it.family_id"), "catalog_source": F.lit("local"), "status": F.lit("verified"), "guard": F.col("__it.guard"), "steps": clean, "reuse_success_count": F.coalesce("__s", F.lit(0)), "reuse_failure_count": F.coalesce("__f", F.lit(0)), "source_legacy_ids": F.array_union(F.coalesce("__ids", F.array().cast("array<string>")), "__legacies")}
    written = last.join(was, "solution_id", "left").select(*[row[c].cast(of[c]).alias(c) for c in solutions.columns])
    solutions = solutions.join(last.select("solution_id"), "solution_id", "left_anti").select(*solutions.columns).unionByName(written)

    final = good.groupBy(F.col("__event").alias("event_id")).agg(F.max_by(F.struct("family_id", "solution_id", F.trim("root_cause").alias("root_cause"), F.trim("verification").alias("verification")), "ord").alias("__it"), F.max("at").alias("__at"))
    bound = events.join(final, "event_id", "left")
    now = {c: F.coalesce(f"__it.{c}", c) for c in ("family_id", "solution_id", "root_cause", "verification")}
    put = lambda value, c: F.when(F.col("__it").isNotNull(), value).otherwise(F.col(c))
    now |= {"confidence": put(F.lit("explicit"), "confidence"), "candidates": put(F.array().cast("array<string>"), "candidates"), "status": put(F.lit("verified"), "status"), "last_seen": F.coalesce("__at", "last_seen")}
    events = bound.select(*[now.get(c, F.col(c)).alias(c) for c in events.columns])
    return {"families": families, "solutions": solutions, "events": events, "faults": faults}


def consistent(tables: dict[str, DataFrame]) -> DataFrame:
    """What is wrong between the tables: the check of a commit."""
    return registry.faults(tables["families"], tables["solutions"], tables["events"])


def _beside(rows: DataFrame, key: str, found: DataFrame, *also: str) -> DataFrame:
    """rows with what is found by key (and by columns that both have); those without a key are dealt by request, not all to one task."""
    right = found.withColumnsRenamed({c: f"__found_{c}" for c in (key, *also)})
    same = (F.coalesce(key, F.col("request_id").cast("string")) == F.col(f"__found_{key}")) & F.col(key).isNotNull()
    for c in also:
        same &= F.col(c) == F.col(f"__found_{c}")
    return rows.join(right.hint("merge"), same, "left").drop(*[f"__found_{c}" for c in (key, *also)])


def _decided(requests: DataFrame, families: DataFrame, solutions: DataFrame) -> DataFrame:
    """What preflight() tells but for lists of families, with the component as __c; action is null where no family is named."""
    component = registry.component_name(F.col("component")).alias("__c")
    asked = requests.select("request_id", component, "family_id", _environment().alias("__env"))
    members = families.select(component, "family_id", F.lit(1).alias("__member")).distinct()
    status = solutions.groupBy("family_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "verified", F.col("solution_id")))).alias("solution_ids"),
        F.array_sort(F.collect_set(F.when(F.col("status").isin("regressed", "retired"), F.col("solution_id")))).alias("blocked"),
        F.max_by(F.when(F.col("status") == "verified", F.col("guard")), F.when(F.col("status") == "verified", F.col("solution_id"))).alias("__guard"),
    )
    none = F.array().cast("array<string>")
    rows = _beside(_beside(asked, "family_id", status), "family_id", members, "__c").withColumns({c: F.coalesce(c, none) for c in ("solution_ids", "blocked")})
    one = F.size("solution_ids") == 1
    action = (
        F.when(F.col("family_id").isNull(), None)
        .when(F.col("__member").isNull(), "needs-classification")
        .when(~one & (F.size("blocked") > 0), "local-solution-blocked")
        .when(~one, "needs-solution-review")
        .when(~registry.guard_holds(F.col("__guard"), F.col("__env")), "guard-not-satisfied")
        .otherwise("use-verified-solution")
    )
    rows = rows.withColumn("action", action)
    found = F.col("action").isin("guard-not-satisfied", "use-verified-solution")
    review = F.col("action").isin("local-solution-blocked", "needs-solution-review")
    return rows.select("request_id", "__c", "action", F.when(found, F.get("solution_ids", F.lit(0))).alias("solution_id"), F.when(review, F.col("solution_ids")).otherwise(none).alias("solution_ids"), F.when(review, F.col("blocked")).otherwise(none).alias("blocked"))


def _listed(rows: DataFrame, requests: DataFrame, families: DataFrame, told: Callable[[Column], Column]) -> DataFrame:
    """Decided rows with families of their component where these are asked for.

    Lists are long, and many rows have the same: a component's requests are cut into parts of about LIST_ROWS by their ids, each
    part gets one copy of the list, and parts are dealt to as many tasks as the requests ask.
    """
    component = registry.component_name(F.col("component")).alias("__c")
    own = families.where("family_id is not null").groupBy(component).agg(told(F.array_sort(F.collect_set("family_id"))).alias("__ids"))
    parts = requests.groupBy(component).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("__parts"))
    copies = own.join(parts, "__c").select("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"), "__ids")
    cut = rows.join(parts, "__c").withColumn("__part", F.pmod(F.xxhash64("request_id"), "__parts")).drop("__parts")
    # By a fixed number, since Spark would put parts together by the size of rows without their lists.
    wide = cut.repartition(scan.tasks(requests, LIST_ROWS), "__c", "__part").join(copies.hint("merge"), ["__c", "__part"], "left")
    action = F.coalesce("action", F.when(F.col("__ids").isNotNull(), "candidate-families").otherwise("continue-without-runtime-write"))
    ids = F.when(action.isin("candidate-families", "needs-classification"), F.col("__ids"))
    more = [c for c in rows.columns if c not in ("request_id", "__c", "action", "solution_id", "solution_ids", "blocked")]
    return wide.select("request_id", action.alias("action"), "solution_id", F.coalesce(ids, told(F.array().cast("array<string>"))).alias("family_ids"), "solution_ids", "blocked", (action == "use-verified-solution").alias("reuse_required"), *more)


def preflight(requests: DataFrame, families: DataFrame, solutions: DataFrame, told: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """What to do about each request (request_id, component, family_id, environment) before work starts: action, with the
    solution to use, families that may fit, and solutions that are blocked.

    Without a family: those of the component. With one: its only verified solution, if its guard holds. told makes of a list of
    families what family_ids holds; it is made once a component, not once a request.
    """
    return _listed(_decided(requests, families, solutions), requests, families, told)


def preflight_with_fallback(requests: DataFrame, local: tuple[DataFrame, DataFrame], public: tuple[DataFrame, DataFrame]) -> DataFrame:
    """preflight() over local tables (families, solutions) with what public ones add; source tells where the solution is from.

    Local rows win; a family's solutions are those of both. So a solution that is blocked locally stays blocked.
    """
    (lf, ls), (pf, ps) = local, public
    theirs = pf.select("family_id", F.col("solution_ids").alias("__theirs"))
    none = F.array().cast("array<string>")
    united = lf.join(theirs, "family_id", "left").withColumn("solution_ids", F.array_sort(F.array_union(F.coalesce("solution_ids", none), F.coalesce("__theirs", none)))).select(*lf.columns)
    families = united.unionByName(pf.join(lf.select("family_id"), "family_id", "left_anti").select(*lf.columns))
    solutions = ls.unionByName(ps.join(ls.select("solution_id"), "solution_id", "left_anti").select(*ls.columns))
    rows = _decided(requests, families, solutions)
    own = ls.select("solution_id", F.lit(True).alias("__own"))
    source = F.when(~F.col("action").eqNullSafe("use-verified-solution"), "combined").when(F.col("__own"), "local").otherwise("public")
    return _listed(_beside(rows, "solution_id", own).select(*rows.columns, source.alias("source")), requests, families, lambda ids: ids)


def capture_incidents(incidents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incidents after reports, and advice of each (request_id, action, id).

    A report that a verified incident matches counts there and is told to use its solution; any other is recorded under its
    own id. incidents: id, component, symptom_signature, environment, status, first_seen, last_seen, occurrences;
    requests: request_id, component, symptom, environment, at.
    """
    asked = requests.withColumn("environment", _environment())
    held = incidents.withColumn("environment", _environment())
    ranked = registry.match(held, asked).join(held.select("id", "status"), "id").where(F.col("status").isin("verified", "promoted"))
    best = ranked.groupBy("request_id").agg(F.min_by("id", "rank").alias("__best"))
    own = registry.incident_id(F.col("component"), F.col("symptom"), registry.scope_json(F.col("environment")))
    rows = asked.join(best, "request_id", "left").withColumn("__id", F.coalesce("__best", own))
    advice = rows.select("request_id", F.when(F.col("__best").isNotNull(), "use-verified-solution").otherwise("recorded-observation").alias("action"), F.col("__id").alias("id"))
    first = rows.groupBy(F.col("__id").alias("id")).agg(F.min_by(F.struct("component", "symptom", registry.scope_json(F.col("environment")).alias("scope")), F.struct("at", "request_id")).alias("__it"), F.min("at").alias("__first"), F.max("at").alias("__last"), F.count(F.lit(1)).alias("__times"))
    kinds = {f.name: f.dataType for f in incidents.schema.fields}
    counted = held.join(first.select("id", "__last", "__times"), "id", "left")
    old = counted.select(*[(F.greatest("last_seen", "__last") if c == "last_seen" else (F.col("occurrences") + F.coalesce("__times", F.lit(0))).cast(kinds[c]) if c == "occurrences" else F.col(c)).alias(c) for c in incidents.columns])
    made = {"id": F.col("id"), "component": F.trim("__it.component"), "symptom_signature": F.trim("__it.symptom"), "environment": F.from_json("__it.scope", "map<string,string>"), "status": F.lit("observed"), "first_seen": F.col("__first"), "last_seen": F.col("__last"), "occurrences": F.col("__times")}
    new = first.join(incidents.select("id"), "id", "left_anti").select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in incidents.columns])
    return old.unionByName(new), advice
