"""Rules of annotations, completeness, alignment, quotes and channels beside their SQL."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import annotations, graph, joins, registry
from plumbline.plans import catalog
from plumbline.sources import pages

AT = "/root/testdata/sf0.01"


def test_completeness_of_cycles_and_depth(spark):
    parsed = spark.createDataFrame([("r", "index", ["a", "b"], None), ("a", "index", ["r", "c"], None), ("b", "urlset", [], None), ("c", "index", ["d"], None), ("d", "urlset", [], None), ("x", "index", ["gone"], None), ("y", "index", ["x"], None), ("z", "index", ["w"], None), ("w", None, [], "invalid-xml")], "path string, kind string, child_sitemaps array<string>, problem string")
    seeds = spark.createDataFrame([("r", "o1"), ("y", "o2"), ("z", "o3"), ("d", "o2"), ("nowhere", "o4")], "url string, origin string")
    deep = pages.sitemap_completion(parsed, seeds, 5)
    assert {r.url: r.complete for r in deep.collect()} == {"r": True, "a": True, "b": True, "c": True, "d": True, "x": False, "y": False, "z": False, "w": False, "gone": False, "nowhere": False}
    assert sorted(r.origin for r in pages.exhaustive_origins(deep, seeds).collect()) == ["o1", "o2"]
    flat = {r.url: r.complete for r in pages.sitemap_completion(parsed, seeds.where("url = 'r'"), 1).collect()}
    assert flat == {"r": False, "a": False, "b": True}  # c is named below the bound
    none = graph.complete_upward(spark.createDataFrame([], "node string, whole boolean"), spark.createDataFrame([], "parent string, child string"))
    assert none.count() == 0


def test_quotes_with_context(spark):
    page = spark.createDataFrame([(1, "a the b the c the b".split()), (2, ["the"] * 2000), (3, []), (4, None)], "page int, tokens array<string>")
    quote = spark.createDataFrame([("q1", ["the", "b"], ["a"], None), ("q2", ["the", "b"], None, ["the"]), ("q3", ["b"], ["the"], []), ("q4", ["the", "b"], ["x", "a"], None), ("q5", [], None, None), ("q6", ["c", "the", "b"], [], ["z"]), ("q7", ["unseen", "b"], None, None)], "quote string, tokens array<string>, before array<string>, after array<string>")
    assert sorted(tuple(r) for r in joins.occurrences(page, quote).collect()) == [(1, "q1", 1), (1, "q2", 1), (1, "q3", 2), (1, "q3", 6)]


def test_alignment_conflicts(spark):
    records = spark.createDataFrame([(1, "10.a", "t one", "A1"), (2, "10.a", "", None), (3, "", "t two", "lost"), (4, "", "none", None)], "number int, doi string, title_key string, link_key string")
    parents = spark.createDataFrame([("P1", "10.a", "t one", 1, "2020", "v", "u"), ("P2", "", "t two", 0, None, "", "u"), ("P3", None, "t two", 2, "2020", "v", None)], "key string, doi string, title_key string, creators int, date string, venue string, url string")
    attachments = spark.createDataFrame([("A1", "P1"), ("A2", "P1"), ("A3", None)], "key string, parent string")
    got = {r.number: (r.parent, r.stage, r.candidates, r.children, r.claimed, r.missing) for r in joins.aligned(records, parents, attachments).collect()}
    assert got == {1: ("P1", "link", 1, 2, 2, []), 2: ("P1", "doi", 1, 2, 2, []), 3: ("P2", "title", 2, 0, 1, ["doi", "creators", "date", "venue"]), 4: (None, None, 0, 0, 0, [])}


BASE = {"id": "i", "page": "1", "annotation_type": "highlight", "kind": "k", "color": "c", "note_question": "q", "claim": "it shows that one two three", "reason": "because of four five six seven", "information_roles": ["mechanism"], "evidence": "e", "confidence": "1", "quote": "a quote of more than six words here"}


@pytest.mark.parametrize(
    ("change", "faults"),
    [
        ({}, []),
        ({"claim": None, "color": ""}, ["missing: claim, color"]),
        ({"claim": "short", "information_roles": ["zzz", "method"]}, ["unknown roles: zzz", "method without mechanism or result", "claim explains nothing"]),
        ({"quote": "42 %"}, ["number without context", "quote is too short"]),
        ({"quote": "Our  Approach", "relation": True}, ["quote is a fragment"]),
        ({"annotation_type": "area"}, ["area lacks visual_object", "area lacks its rectangle"]),
        ({"annotation_type": "ink", "selection_mode": "key-term"}, ["mode needs a highlight", "unknown annotation type"]),
        ({"selection_mode": "other"}, ["unknown selection mode"]),
        ({"selection_mode": "key-term", "quote": "μ", "context_summary": "x", "annotation_comment": "y"}, []),
        ({"selection_mode": "key-link", "quote": "http://127.0.0.1/", "link_context": "x", "annotation_comment": "y", "information_roles": ["support_link"]}, ["key-link is no public address"]),
        ({"selection_mode": "author-name", "kind": "author-background", "information_roles": ["author_context"], "author_context": "x", "external_evidence": "https://x.org", "external_sources": ["https://x.org", "ftp://y"], "verified_at": "2023-02-29", "annotation_comment": "x"}, ["author-name sources are no public addresses", "author-name date is no date", "author-name comment lacks its prefix"]),
        ({"annotation_schema_version": 0}, ["schema version is no positive number"]),
        ({"annotation_schema_version": 3}, ["comment is empty"]),
    ],
)
def test_annotation_rules(spark, change, faults):
    kinds = {"information_roles": "array<string>", "external_sources": "array<string>", "relation": "boolean", "annotation_schema_version": "int"}
    item = BASE | change
    row = spark.createDataFrame([tuple(item.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in item))
    assert annotations.information_faults(row).first().faults == faults


def test_notices(spark):
    asked = [("tool", "Patch refused by SANDBOX", 1), ("PowerShell", "bad input", 2), ("x", "file Not Found", 4), ("x", "sandbox", 5), ("git", "odd git state", 13), ("x", "y", None), (None, "DNS", 7)]
    got = spark.createDataFrame(asked, "c string, s string, n int").select("n", registry.notice(F.col("c"), F.col("s")).alias("t")).collect()
    assert all(r.t == (registry.NOTICE if r.n is None else registry.NOTICES[r.n][1]) for r in got)


def test_channels_of_whole_events(spark):
    """Every event against the rules, written out once more over plain lists."""
    rows = spark.read.parquet(f"{AT}/events.parquet").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "user_id", "value").collect()
    want, kept = [], {}
    for kind, us, i, user, value in sorted(map(tuple, rows), key=lambda r: (r[0], r[1], r[2])):
        c = kept.setdefault(kind, {"open": [], "idle": set(), "missed": [], "tier": 24, "slow": False, "session": ""})
        at, task, what = us / 1e6, str(user % 40), i % 10
        out = []
        for lease in sorted(x for x in c["open"] if x[1] <= at):
            out.append(("task", lease[0], "interrupted"))
            c["open"].remove(lease)
        mine = [x for x in c["open"] if x[0] == task]
        if what < 4:
            out.append(("task", task, "refused" if mine else "leased"))
            if not mine:
                c["open"].append((task, at + value * 600, c["session"]))
        elif what < 6 or (what == 9 and i % 100 != 9):
            out.append(("task", task, ("done" if what < 6 else "failed") if mine else "stale"))
            if mine:
                c["open"].remove(mine[0])
        elif what == 9:
            c["session"] = str(i)
            out += [("task", t, "interrupted") for t in sorted(x[0] for x in c["open"])]
            c["open"] = []
        elif what == 7 and str(user % 30) not in c["missed"]:
            c["missed"].append(str(user % 30))
            out.append(("query", str(user % 30), "to make up"))
        elif what == 8 and str(user % 30) in c["missed"]:
            c["missed"].remove(str(user % 30))
            out.append(("query", str(user % 30), "made up"))
        elif what == 6:
            heavy, tier = value > 45 or (kind == "view" and value > 25), c["tier"]
            if tier == 40:
                c["tier"], c["slow"], did = (32, True, "retreat-one-tier") if heavy else (40, False, "hold")
            elif heavy:
                c["tier"], c["slow"], did = {32: 24}.get(tier, max(1, tier * 7 // 10)), False, "backoff"
            else:
                c["tier"], c["slow"], did = min(t for t in (24, 32, 40) if t > tier), False, "scale-up"
            out.append(("tier", str(c["tier"]), did))
        want += [(kind, i, *o) for o in out]
    got = [tuple(r) for r in catalog.QUERIES["ev_channel_fold"](spark, AT).collect()]
    assert sorted(got) == sorted(want) and {r[4] for r in got} >= {"interrupted", "stale", "done", "refused", "backoff", "scale-up", "made up"}
