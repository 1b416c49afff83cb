"""The incident registry as three tables: problem families, solutions and events.

families: family_id, component, operation, failure_phase, error_class, feature_groups (array of arrays), any_features, solution_ids
solutions: solution_id, family_id, status, guard (struct<os, shell_contains, environment_equals>), reuse_success_count, reuse_failure_count
events: event_id, legacy_id, component, symptom_signature, family_id, solution_id, environment (map), status, verification, occurrences,
        first_seen, last_seen, legacy_reuse_success_count, legacy_reuse_failure_count
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import squeezed
from plumbline.operators.joins import longest_prefix

UNVERIFIED = ("", "not-yet-verified", "unconfirmed")


def signature(text: Column) -> Column:
    """A symptom with run-dependent parts replaced: ids, times, lines and counters."""
    out = F.lower(squeezed(text))
    # What changes between runs, in this order.
    for pattern, put in (
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
        (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:z|[+-][0-9]{2}:[0-9]{2})?\b", "<timestamp>"),
        (r"\bline\s+[0-9]+\b", "line <n>"),
        (r"\b(run|tmp|temp|pid|process|attempt|retry)([-_ ]+)[0-9]+\b", "$1$2<n>"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return out


def component_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[._:/\\\s]+", "-"), "^-+|-+$", "")


def canonical_components(rows: DataFrame, exact: DataFrame, prefixes: DataFrame, column: str = "component") -> DataFrame:
    """rows with `canonical`: an exact rule (name, value), else the first prefix rule (prefix, value, ord), else the plain name."""
    named = rows.withColumn("__plain", component_name(F.col(column)))
    found = longest_prefix(named, "__plain", prefixes).withColumnRenamed("value", "__by_prefix")
    return found.join(exact.select(F.col("name").alias("__plain"), F.col("value").alias("__exact")), "__plain", "left").select(*rows.columns, F.coalesce("__exact", "__by_prefix", "__plain").alias("canonical"))


def scope_json(environment: Column) -> Column:
    """A map as JSON in order of its keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(environment))))


def incident_id(component: Column, symptom: Column, scope: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", F.lower(F.trim(component)), signature(symptom), F.lower(F.trim(F.coalesce(scope, F.lit(""))))), 256), 1, 20)


# What an incident is told as, by the first rule whose every group of words has one in its signature.
NOTICES = (
    ((("apply_patch", "apply-patch"),), "补丁工具无法准备当前 Windows 工作区"),
    ((("patch",), ("sandbox",)), "补丁工具无法准备当前 Windows 工作区"),
    ((("powershell",), ("pipeline", "pipe", "input")), "PowerShell 管道输入处理失败"),
    ((("browser", "bing", "navigation"),), "浏览器无法打开 Bing 搜索页面"),
    ((("path", "directory", "file not found", "not found"),), "文件或目录路径不正确"),
    ((("permission", "access denied", "sandbox"),), "当前操作受到权限或沙箱限制"),
    ((("test", "validation", "assertion"),), "测试或结果验证未通过"),
    ((("network", "timeout", "dns"),), "网络连接或外部服务访问失败"),
    ((("python", "yaml", "pyyaml", "matplotlib", "fitz", "pymupdf", "user-site", "dependency", "site-package"),), "Python 依赖缺失或沙箱不可见"),
    ((("zotero",),), "Zotero 操作失败"),
    ((("thread", "list_threads", "read_thread"),), "Codex 线程接口调用失败"),
    ((("ocr", "vision", "image", "figure", "截图", "图像"),), "图像或截图读取失败"),
    ((("ripgrep", "rg regex", "rg-"),), "ripgrep 检索表达式失败"),
    ((("git ", "repo", "worktree"),), "Git 仓库或工作区状态异常"),
)
NOTICE = "工具执行失败，详细原因已写入故障库"


def notice(component: Column, symptom: Column) -> Column:
    """What a user is told of an incident."""

    def told(said: Column) -> Column:
        out = F.lit(NOTICE)
        for groups, text in reversed(NOTICES):
            hit = F.lit(True)
            for words in groups:
                hit &= reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in words])
            out = F.when(hit, text).otherwise(out)
        return out

    # As an element, a signature is made once; as a plain column it would be for every word.
    return F.get(F.transform(F.array(signature(F.concat_ws(" ", component, symptom))), told), F.lit(0))


def upsert_incidents(known: DataFrame, captured: DataFrame) -> DataFrame:
    """Incidents by id: first seen kept, sightings added up, the latest of everything else. Both: id, status, first_seen, last_seen, occurrences, detail.

    A verified incident that is captured as observed again is refused: it must be marked as regressed.
    """
    rows = known.withColumn("__new", F.lit(0)).unionByName(captured.withColumn("__new", F.lit(1)))
    latest = F.struct("__new", "last_seen")
    merged = rows.groupBy("id").agg(F.max_by("status", latest).alias("status"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"), F.max_by("detail", latest).alias("detail"), F.max(F.when((F.col("__new") == 0) & (F.col("status") == "verified"), 1)).alias("__was"), F.max(F.col("__new")).alias("__touched"))
    refused = (F.col("__was") == 1) & (F.col("__touched") == 1) & (F.col("status") == "observed")
    return merged.withColumn("status", F.when(F.coalesce(refused, F.lit(False)), F.raise_error(F.lit("a verified incident cannot return to observed")).cast("string")).otherwise(F.col("status"))).drop("__was", "__touched")


def environment_score(held: Column, asked: Column) -> Column:
    return F.size(F.filter(F.map_entries(asked), lambda e: F.coalesce(F.try_element_at(held, e["key"]) == e["value"], F.lit(False))))


def match(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, id and rank: incidents of the same component where one symptom holds the other; verified, fitting and recent first.

    The component is an equi-join; containment is tested on what it leaves.
    """
    left = requests.select("request_id", component_name(F.col("component")).alias("component"), signature(F.col("symptom")).alias("asked"), F.col("environment").alias("__env"))
    right = incidents.select("id", component_name(F.col("component")).alias("component"), signature(F.col("symptom_signature")).alias("held"), "status", "environment", "last_seen")
    joined = left.join(right, "component").where(F.contains("asked", F.col("held")) | F.contains("held", F.col("asked")))
    order = Window.partitionBy("request_id").orderBy(F.desc(F.col("status") == "verified"), F.desc(environment_score(F.col("environment"), F.col("__env"))), F.desc("last_seen"), "id")
    return joined.select("request_id", "id", F.row_number().over(order).alias("rank"))


def rule_hit() -> Column:
    """Whether a symptom (`asked`) shows one feature of every group, and one of any_features if there are some."""
    shows = lambda f: F.contains(F.col("asked"), f)
    return F.forall("feature_groups", lambda g: F.exists(g, shows)) & ((F.size("any_features") == 0) | F.exists("any_features", shows))


def classify(events: DataFrame, families: DataFrame) -> DataFrame:
    """event_id, family_id, confidence and candidates: a named family, else the only one of equal structure, else the only one whose rule hits.

    events: event_id, component, symptom, named, operation, failure_phase, error_class.
    """
    left = events.select("event_id", component_name(F.col("component")).alias("__c"), signature(F.col("symptom")).alias("asked"), "named", *[F.col(c).alias(f"__{c}") for c in ("operation", "failure_phase", "error_class")])
    joined = left.join(families.withColumn("__c", component_name(F.col("component"))), "__c", "left")
    alike = F.lit(True)
    for c in ("operation", "failure_phase", "error_class"):
        alike = alike & (F.col(f"__{c}") != "") & (F.col(f"__{c}") == F.col(c))
    held = joined.groupBy("event_id", "named").agg(
        F.collect_set(F.when(F.col("named") == F.col("family_id"), F.col("family_id"))).alias("named_hit"),
        F.array_sort(F.collect_set(F.when(alike, F.col("family_id")))).alias("structured"),
        F.array_sort(F.collect_set(F.when(rule_hit(), F.col("family_id")))).alias("rules"),
    )
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    named = F.coalesce(F.col("named"), F.lit("")) != ""
    family = F.when(named, F.coalesce(only("named_hit"), F.raise_error(F.concat(F.lit("unknown family: "), "named")).cast("string"))).otherwise(F.coalesce(only("structured"), only("rules")))
    said = F.when(named, "explicit").when(F.size("structured") == 1, "structured-exact").when(F.size("rules") == 1, "rule-exact").when(F.size("rules") > 1, "candidate").otherwise("unclassified")
    return held.select("event_id", family.alias("family_id"), said.alias("confidence"), F.when(said == "candidate", F.col("rules")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def guard_holds(guard: Column, environment: Column) -> Column:
    """Whether a solution applies: system, shell and settings as its guard asks; no guard asks nothing."""
    of = lambda name: F.lower(F.coalesce(F.try_element_at(environment, F.lit(name)), F.lit("")))
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    system = none(guard["os"]) | F.exists(guard["os"], lambda o: F.lower(o) == of("os"))
    shell = none(guard["shell_contains"]) | F.exists(guard["shell_contains"], lambda s: F.contains(of("shell"), F.lower(s)))
    settings = none(guard["environment_equals"]) | F.forall(F.map_entries(guard["environment_equals"]), lambda e: F.coalesce(F.try_element_at(environment, e["key"]) == e["value"], F.lit(False)))
    return guard.isNull() | (F.coalesce(system, F.lit(False)) & F.coalesce(shell, F.lit(False)) & settings)


def closure_report(events: DataFrame, solutions: DataFrame) -> DataFrame:
    """event_id, closed and the reasons against, in order.

    Solutions of one family and guard go together, as do events of one family and environment: these meet, not each event each
    solution. The least and the greatest solution that fit tell whether it is one.
    """
    bound = solutions.select(F.col("solution_id"), F.col("status").alias("__bound"))
    entries = lambda c: F.array_sort(F.map_entries(c))
    guard = F.to_json(F.when(F.col("guard").isNotNull(), F.struct("guard.os", "guard.shell_contains", entries("guard.environment_equals"))))
    guards = solutions.where("status = 'verified'").groupBy("family_id", guard.alias("__guard")).agg(F.any_value("guard").alias("guard"), F.min("solution_id").alias("__low"), F.max("solution_id").alias("__high"))
    asked = events.withColumn("__env", F.coalesce(F.to_json(entries("environment")), F.lit("")))
    met = asked.groupBy("family_id", "__env").agg(F.any_value("environment").alias("environment")).join(guards, "family_id").where(guard_holds(F.col("guard"), F.col("environment")))
    applicable = met.groupBy("family_id", "__env").agg(F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.lit(True).alias("__fits"))
    joined = asked.join(bound.hint("merge"), "solution_id", "left").join(applicable, ["family_id", "__env"], "left")
    reason = lambda test, text: F.when(test, F.lit(text))
    reasons = F.array_compact(
        F.array(
            reason(F.col("family_id").startswith("unclassified."), "unclassified-family"),
            F.when(F.col("__bound").isNull(), "missing-solution").when(F.col("__bound") != "verified", "solution-not-verified"),
            F.when(F.col("__fits").isNull(), "no-applicable-verified-solution").when(F.col("__low") < F.col("__high"), "ambiguous-applicable-solutions").when(~F.col("__low").eqNullSafe(F.col("solution_id")), "bound-solution-not-applicable"),
            reason(~F.col("status").isin("verified", "promoted"), "event-not-verified"),
            reason(F.lower(F.trim(F.coalesce("verification", F.lit("")))).isin(*UNVERIFIED), "missing-effect-verification"),
        )
    )
    return joined.select("event_id", (F.size(reasons) == 0).alias("closed"), reasons.alias("reasons"))


def report(families: DataFrame, solutions: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals; attributed reuse is counted on solutions, the rest on events."""
    classified = ~F.col("family_id").startswith("unclassified.")
    e = events.agg(F.count(F.lit(1)).alias("events"), F.count(F.when(~classified, 1)).alias("unclassified"), F.count(F.when(classified & F.col("solution_id").isNotNull(), 1)).alias("__reusable"), F.coalesce(F.sum("legacy_reuse_success_count"), F.lit(0)).alias("__ls"), F.coalesce(F.sum("legacy_reuse_failure_count"), F.lit(0)).alias("__lf"))
    s = solutions.agg(F.count(F.lit(1)).alias("solutions"), F.coalesce(F.sum("reuse_success_count"), F.lit(0)).alias("__s"), F.coalesce(F.sum("reuse_failure_count"), F.lit(0)).alias("__f"))
    one = families.agg(F.count(F.lit(1)).alias("problem_families"))
    return e.join(F.broadcast(s)).join(F.broadcast(one)).select("events", "problem_families", "solutions", "unclassified", F.coalesce(F.try_divide("__reusable", "events"), F.lit(0.0)).alias("reuse_coverage"), (F.col("__s") + F.col("__ls")).alias("reuse_success_count"), (F.col("__f") + F.col("__lf")).alias("reuse_failure_count"))


def promotable(events: DataFrame, solutions: DataFrame, least: int = 2) -> DataFrame:
    """solution_id and events of verified solutions that at least so many verified events rest on."""
    proven = events.where(F.col("status").isin("verified", "promoted")).join(solutions.where("status = 'verified'").select("solution_id"), "solution_id", "left_semi")
    return proven.groupBy("solution_id").agg(F.array_sort(F.collect_list("event_id")).alias("events")).where(F.size("events") >= least)


def retry_blocked(requests: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Requests (incident_id, route, parameters) that repeat a known failure unchanged."""
    from plumbline.functions.hashing import canonical_json

    plain = lambda f: f.withColumn("__p", canonical_json(F.col("parameters")))
    return plain(requests).join(plain(forbidden).select("incident_id", "route", "__p"), ["incident_id", "route", "__p"], "left_semi").drop("__p")


def rename_families(families: DataFrame, solutions: DataFrame, events: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables with old family ids (aliases: old, new) replaced; a family that two rows then share unites their solutions."""
    def swap(frame: DataFrame) -> DataFrame:
        return frame.join(aliases.select(F.col("old").alias("family_id"), "new"), "family_id", "left").withColumn("family_id", F.coalesce("new", "family_id")).select(*frame.columns)

    first = Window.partitionBy("family_id").orderBy(F.col("__old"), "component")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("solution_ids").over(Window.partitionBy("family_id")))))
    moved = families.join(aliases.select(F.col("old").alias("family_id"), "new"), "family_id", "left").withColumn("__old", F.col("new").isNotNull()).withColumn("family_id", F.coalesce("new", "family_id"))
    united = moved.withColumn("solution_ids", every).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*families.columns)
    return united, swap(solutions), swap(events)


def migrate(incidents: DataFrame, families: DataFrame, solutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and solutions of the new model from old incidents (id, component, symptom_signature, status, known_good_solution,
    occurrences, reuse_success_count, reuse_failure_count).

    Counts go to the solution where an incident proves the only one of its family, else they stay with the event. Ids that
    are empty or repeated are conflicts: their events have conflict set and their counts are left out of the solutions.
    """
    asked = incidents.select(F.col("id").alias("event_id"), "component", F.col("symptom_signature").alias("symptom"), F.lit("").alias("named"), *[F.lit("").alias(c) for c in ("operation", "failure_phase", "error_class")])
    told = classify(asked.dropDuplicates(["event_id"]), families)
    only = families.where(F.size("solution_ids") == 1).select("family_id", F.get("solution_ids", F.lit(0)).alias("__sid")).join(solutions.select(F.col("solution_id").alias("__sid"), "equivalence_any"), "__sid")
    joined = incidents.join(told, F.col("id") == F.col("event_id"), "left").join(only, "family_id", "left").withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy("id")))
    plain = signature(F.col("known_good_solution"))
    proves = F.col("status").isin("verified", "promoted") & ~plain.isin("", "unconfirmed") & F.exists("equivalence_any", lambda m: F.contains(plain, signature(m)))
    conflict = (F.coalesce("id", F.lit("")) == "") | (F.col("__times") > 1)
    taken = F.coalesce(proves, F.lit(False)) & ~conflict
    events = joined.select(F.col("id").alias("legacy_id"), F.coalesce("family_id", F.concat(F.lit("unclassified."), "id")).alias("family_id"), F.when(taken, F.col("__sid")).alias("solution_id"), "occurrences", F.when(taken, 0).otherwise(F.col("reuse_success_count")).alias("legacy_reuse_success_count"), F.when(taken, 0).otherwise(F.col("reuse_failure_count")).alias("legacy_reuse_failure_count"), F.when(taken, F.col("reuse_success_count")).otherwise(0).alias("__s"), F.when(taken, F.col("reuse_failure_count")).otherwise(0).alias("__f"), conflict.alias("conflict"))
    used = events.where("solution_id is not null").groupBy("solution_id").agg(F.sum("__s").alias("reuse_success_count"), F.sum("__f").alias("reuse_failure_count"), F.array_sort(F.collect_list("legacy_id")).alias("source_legacy_ids"))
    return events.drop("__s", "__f"), used


def conservation(incidents: DataFrame, events: DataFrame, solutions: DataFrame) -> DataFrame:
    """measure, source and target of each total that a migration must keep and has not."""
    old = incidents.agg(F.countDistinct("id").alias("legacy_ids"), F.sum("occurrences").alias("occurrences"), F.sum("reuse_success_count").alias("reuse_success"), F.sum("reuse_failure_count").alias("reuse_failure"))
    own = events.agg(F.countDistinct("legacy_id").alias("legacy_ids"), F.sum("occurrences").alias("occurrences"), F.sum("legacy_reuse_success_count").alias("s"), F.sum("legacy_reuse_failure_count").alias("f"))
    theirs = solutions.agg(F.coalesce(F.sum("reuse_success_count"), F.lit(0)).alias("s2"), F.coalesce(F.sum("reuse_failure_count"), F.lit(0)).alias("f2"))
    new = own.join(F.broadcast(theirs)).select("legacy_ids", "occurrences", (F.col("s") + F.col("s2")).alias("reuse_success"), (F.col("f") + F.col("f2")).alias("reuse_failure"))
    names = ("legacy_ids", "occurrences", "reuse_success", "reuse_failure")
    tall = lambda f, n: f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(n)) for c in names])).alias("it")).select("it.*")
    return tall(old, "source").join(tall(new, "target"), "measure").where("source != target")


def faults(families: DataFrame, solutions: DataFrame, events: DataFrame) -> DataFrame:
    """fault and id: repeated ids, and references to families and solutions that are not there."""
    def repeated(frame, key, name):
        return frame.groupBy(F.col(key).alias("id")).count().where("count > 1").select(F.lit(f"repeated {name}").alias("fault"), "id")

    def dangling(frame, key, own, target, name):
        return frame.where(F.col(key).isNotNull()).join(target, key, "left_anti").select(F.lit(name).alias("fault"), F.col(own).alias("id"))

    named = events.where(~F.col("family_id").startswith("unclassified."))
    parts = [repeated(families, "family_id", "family"), repeated(solutions, "solution_id", "solution"), repeated(events, "event_id", "event"), dangling(solutions, "family_id", "solution_id", families, "solution of unknown family"), dangling(named, "family_id", "event_id", families, "event of unknown family"), dangling(events, "solution_id", "event_id", solutions, "event of unknown solution")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def materialise(records: DataFrame, catalog: DataFrame, fields: list[str]) -> DataFrame:
    """Solution records with the catalog's fields where they only refer to it (catalog_source = builtin); others as they are.

    fault is set where a reference holds fields of its own, is unknown, or names another family.
    """
    right = catalog.select("solution_id", F.col("family_id").alias("__family"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = records.join(right, "solution_id", "left")
    refers = F.col("catalog_source") == "builtin"
    own = F.lit(False)
    for f in fields:
        own = own | F.col(f).isNotNull()
    fault = F.when(refers & own, "reference with fields of its own").when(refers & F.col("__family").isNull(), "unknown reference").when(refers & (F.col("__family") != F.col("family_id")), "family mismatch")
    rest = [c for c in records.columns if c not in fields]
    return joined.select(*rest, *[F.when(refers, F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields], fault.alias("fault"))


def compact(records: DataFrame, catalog: DataFrame, fields: list[str]) -> DataFrame:
    """Records whose fields are those of the catalog become references to it; changed ones stay whole."""
    right = catalog.select("solution_id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__known"))
    joined = records.join(right, "solution_id", "left")
    same = F.coalesce(F.col("__known"), F.lit(False))
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    rest = [c for c in records.columns if c not in (*fields, "catalog_source")]
    return joined.select(*rest, *[F.when(~same, F.col(f)).alias(f) for f in fields], F.when(same, "builtin").otherwise(F.col("catalog_source")).alias("catalog_source"))


def record_reuse(incidents: DataFrame, results: DataFrame) -> DataFrame:
    """Incidents (id, status, reuse_success_count, reuse_failure_count) after reuses (id, ord, success, effect_verified, cleanup_complete).

    A success counts if its effect is verified and all is cleaned up; any other result counts as a failure. The last result
    decides: a failure marks a regression, a success verifies.
    """
    good = F.col("success") & F.col("effect_verified") & F.col("cleanup_complete")
    sums = results.groupBy("id").agg(F.count(F.when(good, 1)).alias("__s"), F.count(F.when(~good, 1)).alias("__f"), F.max_by(good, "ord").alias("__last"))
    joined = incidents.join(sums, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("id", F.when(F.col("__last").isNull(), F.col("status")).when(F.col("__last"), "verified").otherwise("regressed").alias("status"), (F.col("reuse_success_count") + zero("__s")).alias("reuse_success_count"), (F.col("reuse_failure_count") + zero("__f")).alias("reuse_failure_count"))
