from pyspark.sql import functions as F

from plumbline.operators import notes as N
from plumbline.operators import registry as R

FAMILIES = "family_id string, component string, operation string, failure_phase string, error_class string, feature_groups array<array<string>>, any_features array<string>, solution_ids array<string>"
SOLUTIONS = "solution_id string, family_id string, status string, guard struct<os:array<string>,shell_contains:array<string>,environment_equals:map<string,string>>, reuse_success_count int, reuse_failure_count int, equivalence_any array<string>"
EVENTS = "event_id string, legacy_id string, family_id string, solution_id string, environment map<string,string>, status string, verification string, occurrences int, legacy_reuse_success_count int, legacy_reuse_failure_count int"


def tables(spark):
    families = spark.createDataFrame([("git.lock", "git", "push", "run", "lock", [["lock"], ["index", "head"]], [], ["s1"]), ("git.net", "git", "push", "run", "net", [["timeout"]], [], []), ("git.any", "git", "", "", "", [["timeout"]], ["remote"], [])], FAMILIES)
    solutions = spark.createDataFrame([("s1", "git.lock", "verified", (["linux"], [], {}), 1, 0, ["remove the lock"]), ("s2", "git.net", "draft", None, 0, 1, [])], SOLUTIONS)
    return families, solutions


def test_classify(spark):
    families, _ = tables(spark)
    asked = [("1", "Git", "Unable to LOCK index file", None, "", "", ""), ("2", "git", "timeout to remote", "", "", "", ""), ("3", "git", "odd", "", "push", "run", "net"), ("4", "git", "x", "git.any", "", "", ""), ("5", "tar", "lock index", "", "", "", "")]
    got = {r.event_id: (r.family_id, r.confidence, r.candidates) for r in R.classify(spark.createDataFrame(asked, "event_id string, component string, symptom string, named string, operation string, failure_phase string, error_class string"), families).collect()}
    assert got == {"1": ("git.lock", "rule-exact", []), "2": (None, "candidate", ["git.any", "git.net"]), "3": ("git.net", "structured-exact", []), "4": ("git.any", "explicit", []), "5": (None, "unclassified", [])}


def test_closure_report_and_faults(spark):
    families, solutions = tables(spark)
    events = spark.createDataFrame([("a", "1", "git.lock", "s1", {"os": "Linux"}, "verified", "done", 2, 0, 0), ("b", "2", "git.lock", "s1", {"os": "mac"}, "observed", "", 1, 3, 1), ("c", "3", "unclassified.x", None, {}, "verified", "ok", 1, 0, 0), ("d", "4", "gone", "s9", {}, "verified", "ok", 1, 0, 0)], EVENTS)
    got = {r.event_id: (r.closed, r.reasons) for r in R.closure_report(events, solutions).collect()}
    assert got["a"] == (True, []) and got["b"] == (False, ["no-applicable-verified-solution", "event-not-verified", "missing-effect-verification"])
    assert got["c"][1] == ["unclassified-family", "missing-solution", "no-applicable-verified-solution"]
    assert sorted(map(tuple, R.faults(families, solutions, events).collect())) == [("event of unknown family", "d"), ("event of unknown solution", "d")]
    totals = R.report(families, solutions, events).first()
    assert (totals.events, totals.unclassified, totals.reuse_coverage, totals.reuse_success_count, totals.reuse_failure_count) == (4, 1, 0.75, 4, 2)
    assert [tuple(r) for r in R.promotable(events, solutions, 1).collect()] == [("s1", ["a"])]


def test_migration_conserves(spark):
    families, solutions = tables(spark)
    incidents = spark.createDataFrame([("i1", "git", "lock on index", "verified", "Remove the LOCK file", 3, 5, 1), ("i2", "git", "lock on head", "observed", "", 2, 1, 0), ("i3", "tar", "x", "verified", "y", 1, 1, 0)], "id string, component string, symptom_signature string, status string, known_good_solution string, occurrences int, reuse_success_count int, reuse_failure_count int")
    events, used = R.migrate(incidents, families, solutions)
    assert {r.legacy_id: (r.family_id, r.solution_id) for r in events.collect()} == {"i1": ("git.lock", "s1"), "i2": ("git.lock", None), "i3": ("unclassified.i3", None)}
    assert [tuple(r) for r in used.collect()] == [("s1", 5, 1, ["i1"])] and R.conservation(incidents, events, used).count() == 0
    assert [tuple(r) for r in R.conservation(incidents, events.where("legacy_id != 'i3'"), used).orderBy("measure").collect()] == [("legacy_ids", 3, 2), ("occurrences", 6, 5), ("reuse_success", 7, 6)]


def test_incidents(spark):
    row = spark.range(1).select(R.signature(F.lit("Attempt 3 failed at line 7 on 2024-01-02T03:04:05Z  retry_12")).alias("s"), R.component_name(F.lit(" Git::Push/x ")).alias("c"), R.incident_id(F.lit("Git"), F.lit("x"), R.scope_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))).alias("i")).first()
    assert (row.s, row.c) == ("attempt <n> failed at line <n> on <timestamp> retry_<n>", "git-push-x") and len(row.i) == 20
    kind = "id string, status string, first_seen string, last_seen string, occurrences int, detail string"
    known = spark.createDataFrame([("a", "observed", "1", "2", 3, "old")], kind)
    assert [tuple(r) for r in R.upsert_incidents(known, spark.createDataFrame([("a", "verified", "5", "5", 1, "new")], kind)).collect()] == [("a", "verified", "1", "5", 4, "new")]
    requests = spark.createDataFrame([("r", "git", "fatal: index lock exists", {"os": "l"})], "request_id string, component string, symptom string, environment map<string,string>")
    held = spark.createDataFrame([("1", "Git", "index lock", "observed", {"os": "l"}, "9"), ("2", "git", "lock exists", "verified", {}, "1"), ("3", "tar", "index lock", "verified", {}, "1")], "id string, component string, symptom_signature string, status string, environment map<string,string>, last_seen string")
    assert [tuple(r) for r in R.match(held, requests).orderBy("rank").collect()] == [("r", "2", 1), ("r", "1", 2)]


NOTES = {
    "a.md": "# Top\nsee [[b]] and [[b#Deep Head|x]] and [[b#gone]] `[[no]]`\n```\n[[code]]\n```\n![[img.png]] [w](https://x.org) [r](sub/c.md) ^top-1\n",
    "sub/b.md": "## Deep *Head* ##\ntext ^blk\n[[a#^top-1]] [[a#^none]] [[dup]] [[never]]\n",
    "sub/c.md": "```\nopen fence [[x]]\n",
    "p/dup.md": "",
    "q/dup.md": "# H\n![i](m/img.png)\n",
}


def test_links(spark):
    notes = spark.createDataFrame(list(NOTES.items()), "path string, content string")
    files = notes.select("path").unionByName(spark.createDataFrame([("m/img.png",), ("m/lost.png",)], "path string"))
    assert N.links(notes).count() == 11
    got = {(r.path, r.target): (r.kind, r.resolved) for r in N.issues(notes, files).collect()}
    assert got == {
        ("a.md", "b"): ("relocatable-file", "sub/b.md"), ("a.md", "b#Deep Head"): ("relocatable-file", "sub/b.md"), ("a.md", "b#gone"): ("missing-heading", "sub/b.md"), ("a.md", "img.png"): ("relocatable-file", "m/img.png"),
        ("sub/b.md", "a#^none"): ("missing-block", "a.md"), ("sub/b.md", "dup"): ("ambiguous-file", None), ("sub/b.md", "never"): ("missing-file", None), ("q/dup.md", "m/img.png"): ("missing-file", None),
    }
    fixed = dict(N.repaired(notes, files).collect())
    assert "[[sub/b]] and [[sub/b#Deep Head|x]]" in fixed["a.md"] and fixed["sub/c.md"] == NOTES["sub/c.md"]
    heads = {r.path: (r.headings, r.block_ids) for r in N.index(notes).collect()}
    assert heads["sub/b.md"] == (["deep head"], ["blk"]) and heads["a.md"] == (["top"], ["top-1"])
    parts = {(r.path, r.heading): (r.level, r.line, r.images) for r in N.sections(notes).collect()}
    assert parts[("a.md", "top")] == (1, 1, ["img.png"]) and parts[("q/dup.md", "h")] == (1, 1, ["m/img.png"])
    assert [r.path for r in N.unreferenced_media(N.links(notes), files.where("path like '%.png'")).collect()] == ["m/lost.png"]


def test_references_and_reuse(spark):
    kind = "solution_id string, family_id string, catalog_source string, title string"
    catalog = spark.createDataFrame([("s", "f", "T"), ("t", "f", "U")], "solution_id string, family_id string, title string")
    records = spark.createDataFrame([("s", "f", "builtin", None), ("t", "g", "builtin", None), ("x", "f", "builtin", None), ("t", "f", "builtin", "own"), ("y", "f", None, "mine")], kind)
    got = sorted((r.solution_id, r.title, r.fault) for r in R.materialise(records, catalog, ["title"]).where("solution_id != 't'").collect())
    assert got == [("s", "T", None), ("x", None, "unknown reference"), ("y", "mine", None)]
    assert {r.fault for r in R.materialise(records, catalog, ["title"]).where("solution_id = 't'").collect()} == {"family mismatch", "reference with fields of its own"}
    whole = spark.createDataFrame([("s", "f", None, "T"), ("t", "f", None, "changed")], kind)
    assert {r.solution_id: (r.title, r.catalog_source) for r in R.compact(whole, catalog, ["title"]).collect()} == {"s": (None, "builtin"), "t": ("changed", None)}
    held = spark.createDataFrame([("a", "verified", 1, 0), ("b", "observed", 0, 0), ("c", "verified", 2, 2)], "id string, status string, reuse_success_count int, reuse_failure_count int")
    results = spark.createDataFrame([("a", 1, True, True, True), ("a", 2, True, False, True), ("b", 1, True, True, True)], "id string, ord int, success boolean, effect_verified boolean, cleanup_complete boolean")
    assert sorted(map(tuple, R.record_reuse(held, results).collect())) == [("a", "regressed", 2, 1), ("b", "verified", 1, 0), ("c", "verified", 2, 2)]
