"""Capture, resolve and preflight over small tables, against what the rules say."""

from pyspark.sql import functions as F

from plumbline.operators import resolution as R
from plumbline.plans.registries import EVENT, FAMILY, SOLUTION

REPORT = "request_id string, ord long, component string, symptom string, named string, operation string, failure_phase string, error_class string, environment map<string,string>, at string"
REQUEST = "request_id string, ord long, event_id string, family_id string, solution_id string, operation string, failure_phase string, error_class string, root_cause string, verification string, steps array<string>, guard struct<os:array<string>,shell_contains:array<string>,environment_equals:map<string,string>>, expected_effect string, domain_semantics boolean, regression_test string, at string"


def family(i, component="git", op="", words=(), solutions=()):
    return (i, component, op, "run" if op else "", "e" if op else "", [list(w) for w in words], [], list(solutions))


def solution(i, of, status="verified", source="local", os=None):
    return (i, of, source, status, ([os], None, None) if os else None, ["do"], 2, 1, ["old"])


def event(i, symptom="odd", of="unclassified.git.x", sol=None, env=None, times=1):
    return (i, f"l{i}", "git", symptom, env or {}, of, "unclassified", [], sol, "observed", "", "", "1", "1", times)


def report(i, symptom, named="", env=None, component="Git", at="5"):
    return (f"r{i}", i, component, symptom, named, "", "", "", env, at)


def tables(spark, families=(), solutions=(), events=()):
    return spark.createDataFrame(list(families), FAMILY), spark.createDataFrame(list(solutions), SOLUTION), spark.createDataFrame(list(events), EVENT)


def test_capture_takes_references_and_counts_on(spark):
    catalog = spark.createDataFrame([family("net", words=[["timeout"]], solutions=["n1", "n2"]), family("lock", words=[["lock"]], solutions=["k1"])], FAMILY)
    remedies = spark.createDataFrame([solution("n1", "net"), solution("n2", "net", "draft"), solution("k1", "lock")], SOLUTION)
    own = tables(spark, [family("mine", words=[["odd thing"]])], [solution("m1", "mine"), solution("m2", "mine")], [event("a", "timeout at line <n>", times=3), event("b", "odd thing", "lock", "k9")])
    asked = spark.createDataFrame([report(1, "Timeout at line 7"), report(2, "timeout at  line 9", at="9"), report(3, "odd thing"), report(4, "fresh", env={"os": "x"}), report(5, "fresh"), report(6, "timeout", component="tar")], REPORT)
    now = R.capture(*own, asked, catalog, remedies)
    events = {r.event_id if len(r.event_id) == 1 else (r.component, r.symptom_signature, len(r.environment)): r for r in now["events"].collect()}
    assert len(events) == 5
    assert (events["a"].family_id, events["a"].solution_id, events["a"].occurrences, events["a"].first_seen, events["a"].last_seen) == ("net", "n1", 5, "1", "9")
    assert (events["b"].family_id, events["b"].solution_id) == ("mine", None)  # another family than before, with two solutions
    assert events["git", "fresh", 1].family_id == events["git", "fresh", 0].family_id and events["git", "fresh", 0].family_id.startswith("unclassified.git.")
    assert events["tar", "timeout", 0].confidence == "unclassified" and events["git", "fresh", 1].legacy_id.startswith("native-v3:event.")
    assert sorted(r.family_id for r in now["families"].collect()) == ["mine", "net"]
    refs = {r.solution_id: (r.catalog_source, r.steps, r.source_legacy_ids) for r in now["solutions"].collect()}
    assert refs.keys() == {"m1", "m2", "n1"} and refs["n1"] == ("builtin", None, [])
    same = R.capture(*own, asked.limit(0), catalog, remedies)
    assert sorted(map(str, same["events"].collect())) == sorted(map(str, own[2].collect())) and same["families"].count() == 1


def test_resolve_upserts_and_refuses(spark):
    own = tables(spark, [family("f1", op="push", solutions=["s1"]), family("f2", "tar", op="pack")], [solution("s1", "f1"), solution("ref", "f1", source="builtin")], [event("a"), event("b"), event("c")])
    catalog = spark.createDataFrame([family("known", op="pull", solutions=["kv"])], FAMILY)
    remedies = spark.createDataFrame([solution("kv", "known")], SOLUTION)

    def asked(i, ev, fam, sol, op="push", verification="seen", steps=("x", " "), effect="works", domain=False, test=None):
        return (f"r{i}", i, ev, fam, sol, op, "run", "e", "why", verification, list(steps), None, effect, domain, test, "9")

    good = [asked(1, "a", "f1", "s1"), asked(2, "lb", "f1", "s1", steps=["last"]), asked(3, "c", "known", "new", op="pull", domain=True, test="t")]
    bad = {"r10": (asked(10, "z", "f1", "s1"), "unknown event"), "r11": (asked(11, "a", "other", "s5"), "identity belongs to another family"), "r12": (asked(12, "a", "f1", "kv"), "solution is reserved by the catalog"), "r13": (asked(13, "a", "f2", "s5", op="new"), "family of another component"), "r14": (asked(14, "a", "f1", "s5", op="new"), "family differs in operation"), "r15": (asked(15, "a", "f1", "ref"), "reference to the catalog"), "r16": (asked(16, "a", "n", "s1", op="n"), "solution of another family"), "r17": (asked(17, "a", "f1", "s1", steps=[" "]), "no steps"), "r18": (asked(18, "a", "f1", "s1", effect=None), "no expected effect"), "r19": (asked(19, "a", "f1", "s1", domain=True), "no regression test"), "r20": (asked(20, "a", "f1", "s1", verification=None), "a field is empty")}
    requests = spark.createDataFrame(good + [b for b, _ in bad.values()], REQUEST)
    now = R.resolve(*own, requests, catalog, remedies)
    assert {r.request_id: r.fault for r in now["faults"].collect()} == {k: f for k, (_, f) in bad.items()}
    events = {r.event_id: (r.family_id, r.solution_id, r.status, r.confidence, r.last_seen) for r in now["events"].collect()}
    assert events == {"a": ("f1", "s1", "verified", "explicit", "9"), "b": ("f1", "s1", "verified", "explicit", "9"), "c": ("known", "new", "verified", "explicit", "9")}
    held = {r.solution_id: (r.family_id, r.catalog_source, r.steps, r.reuse_success_count, r.source_legacy_ids) for r in now["solutions"].collect()}
    assert held["s1"] == ("f1", "local", ["last"], 2, ["old", "la", "lb"]) and held["new"] == ("known", "local", ["x"], 0, ["lc"]) and held["kv"][1] == "builtin" and held["ref"][1] == "builtin"
    assert {r.family_id: r.solution_ids for r in now["families"].collect()} == {"f1": ["s1"], "f2": [], "known": ["kv", "new"]}
    assert R.consistent(now).count() == 0


def test_preflight_with_fallback(spark):
    lf, ls, _ = tables(spark, [family("f"), family("g"), family("h")], [solution("lf", "f", os="Linux"), solution("pg", "g", "regressed")])
    pf, ps, _ = tables(spark, [family("f"), family("g"), family("p")], [solution("lf", "f", "retired"), solution("pg", "g"), solution("pp", "p")])
    asked = [("1", "Git", "f", {"os": "linux"}), ("2", "git", "f", {"os": "mac"}), ("3", "git", "g", {}), ("4", "git", "p", None), ("5", "git", None, {}), ("6", "none", None, {}), ("7", "git", "zz", {}), ("8", "git", "h", {})]
    got = {r.request_id: (r.action, r.solution_id, r.source) for r in R.preflight_with_fallback(spark.createDataFrame(asked, "request_id string, component string, family_id string, environment map<string,string>"), (lf, ls), (pf, ps)).collect()}
    assert got == {"1": ("use-verified-solution", "lf", "local"), "2": ("guard-not-satisfied", "lf", "combined"), "3": ("local-solution-blocked", None, "combined"), "4": ("use-verified-solution", "pp", "public"), "5": ("candidate-families", None, "combined"), "6": ("continue-without-runtime-write", None, "combined"), "7": ("needs-classification", None, "combined"), "8": ("needs-solution-review", None, "combined")}


def test_capture_incidents(spark):
    kind = "id string, component string, symptom_signature string, environment map<string,string>, status string, first_seen string, last_seen string, occurrences long"
    held = spark.createDataFrame([("v", "git", "index lock", {"os": "l"}, "verified", "1", "2", 4), ("o", "git", "net down", {}, "observed", "1", "2", 1)], kind)
    asked = spark.createDataFrame([("a", "Git", "fatal: index lock", {}, "5"), ("b", "git", "net down", {}, "6"), ("c", "git", "New One 1", {"os": "l"}, "7"), ("d", "git", "new  one 1", {"os": "l"}, "8")], "request_id string, component string, symptom string, environment map<string,string>, at string")
    table, advice = R.capture_incidents(held, asked)
    told = {r.request_id: (r.action, r.id) for r in advice.collect()}
    assert told["a"] == ("use-verified-solution", "v") and told["b"][0] == "recorded-observation" and told["c"] == told["d"]
    now = {r.id: (r.status, r.first_seen, r.last_seen, r.occurrences) for r in table.collect()}
    assert now["v"] == ("verified", "1", "5", 5) and now["o"] == ("observed", "1", "2", 1) and now[told["c"][1]] == ("observed", "7", "8", 2) and len(now) == 4
    assert R.capture_incidents(held.limit(0), asked.limit(0))[0].count() == 0


def test_keys_ignore_what_changes_between_runs(spark):
    row = spark.range(1).select(*[R.problem_key(F.lit(c), F.lit(s), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias(n) for n, c, s in (("x", "Git.Push", "Line 3 failed"), ("y", "git push", "line  77 failed"))]).first()
    assert row.x == row.y
