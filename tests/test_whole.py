"""Whole tables against brute force, beside their SQL."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import redact
from plumbline.functions import text as X
from plumbline.functions.urls import corpus_url, is_official
from plumbline.operators import corpus, graph, notes
from plumbline.plans import catalog, commerce, documents
from plumbline.sources import files, index

AT = "/root/testdata/sf0.01"


def column(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{AT}/{name}.parquet").select(*cols).collect()]


def test_whole_part_graph(spark):
    keys = sorted(k for (k,) in column(spark, "part", "p_partkey"))
    assert keys == list(range(len(keys))) and len(keys) > 500
    rank, verified = {0: 0}, {0: True}
    for k in keys[1:]:
        rank[k] = 1 + max(rank[k // 2], rank[k // 3])
        verified[k] = k % 17 != 4 and verified[k // 2] and verified[k // 3]
    got = catalog.QUERIES["part_dependency_order"](spark, AT).collect()
    assert sorted((int(r.id), r["rank"], r.problem) for r in got) == [(k, rank[k], None) for k in keys]
    states = catalog.QUERIES["part_verified_states"](spark, AT).collect()
    assert sorted((int(r.id), r.state) for r in states) == [(k, "verified" if verified[k] else "pending") for k in keys]


def test_axis_of_many_values(spark):
    many = spark.range(250).selectExpr("lpad(cast(id as string), 3, '0') as v")
    assert commerce.axis(many, "v") == [f"{i:03}" for i in range(250)]
    with pytest.raises(ValueError):
        commerce.axis(many, "v", 249)


def test_whole_batch_sizes(spark):
    want, now = [], {}
    for run, at in sorted(column(spark, "events", "user_id", "event_id")):
        size = now.get(run, 16)
        want.append((run, at, size))
        share = at % 10 / 20
        now[run] = min(size * 2, 64) if share >= 0.25 else 8 if share < 0.05 else size
    got = [(r.run, r.ord, r["size"]) for r in catalog.QUERIES["ev_batch_sizes"](spark, AT).collect()]
    assert sorted(got) == want and any(run >= 20 for run, *_ in got)


def test_whole_overlay_and_three_way(spark):
    docs, labels = dict(column(spark, "documents", "doc_id", "lang")), dict(column(spark, "labels", "doc_id", "quality"))
    want = {i: ("local" if i in docs else "public", 9 if i in docs and i % 2 == 0 else labels.get(i)) for i in docs.keys() | labels.keys()}
    got = catalog.QUERIES["doc_label_overlay"](spark, AT).collect()
    assert len(got) == len(want) and {r.doc_id: (r.origin, r.quality) for r in got} == want
    states = Counter()
    for i, lang in docs.items():
        base, left, right = ("edited" if i % k == 0 else lang for k in (6, 7, 9))
        states["equal" if left == right else "right-changed" if base == left else "left-changed" if base == right else "conflict"] += 1
    assert {r.state: r.n for r in catalog.QUERIES["doc_three_way_state"](spark, AT).collect()} == states and sum(states.values()) == len(docs)


def test_controller_folds(spark):
    """Each row of both folds against the rules, written out once more as plain conditions."""
    limit_of = lambda i: 20 if i % 97 == 0 else 64
    state, want = {}, {}
    for i, kind, value in sorted(column(spark, "events", "event_id", "event_type", "value")):
        tier, slowed, marked = state.get(kind, (24, False, False))
        limited, heavy, window = i % 13 == 0, (i % 13 == 0 and i % 4 >= 2) or value > 30, i % 3 == 0
        wait = "stabilize-after-backoff" if slowed else "hold"
        if tier > limit_of(i):
            new, did = (limit_of(i), False, False), "limit-cap"
        elif limited and not heavy:
            new, did = (tier, slowed, marked), wait
        elif tier >= 40:
            new, did = ((min(32, limit_of(i)), True, False), "retreat-one-tier") if heavy else ((40, False, False), "hold")
        elif not window:
            new, did = (tier, slowed, marked or heavy), wait
        elif marked or heavy:
            new, did = ({24: 16, 32: 24}.get(tier, max([t for t in (24, 32, 40) if t < tier], default=max(1, tier * 7 // 10))), False, False), "backoff"
        else:
            new, did = (min(min(t for t in (24, 32, 40) if t > tier), limit_of(i)), False, False), "scale-up"
        want[kind, i] = (tier, new[0], did)
        state[kind] = new
    got = catalog.QUERIES["ev_concurrency_fold"](spark, AT).collect()
    assert len(got) == len(want)
    seen = {(r.backend, r.ord): (r.previous_tier, r.tier, r.action) for r in got}
    wrong = {k: (seen[k], want[k]) for k in want if seen[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]


def test_pace_fold(spark):
    state, want = {}, {}
    for user, i, at, kind, value in sorted(column(spark, "events", "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type", "value")):
        wait, until, dry = state.get(user, (45.0, 0.0, 0))
        if kind == "error":
            if value > 40:
                wait, until, dry = 45.0, max(until, at + 120.0), 0
            elif value >= 15.0:
                wait = min(120.0, 2 * wait)
        elif value < 1:
            dry += 1
            if dry == 2:
                wait, dry = min(120.0, 2 * wait), 0
        else:
            wait, dry = max(30.0, 0.75 * wait), 0
        state[user] = wait, until, dry
        want[str(user), i] = wait, until
    got = {(r.session, r.ord): (r.interval, r.cool_until) for r in catalog.QUERIES["ev_pace_fold"](spark, AT).collect()}
    assert got == want and len({u for u, _ in got}) > 20


def test_stream_concurrency_equals_fold(spark):
    """The stream's limits never bind, and no signal is limited: the tier follows windows and pressure alone."""
    state, want = {}, {}
    for i, kind, value in sorted(column(spark, "events", "event_id", "event_type", "value")):
        tier, slowed, marked = state.get(kind, (24, False, False))
        heavy, window = value > 30, i % 3 == 0
        if tier >= 40:
            new, did = ((32, True, False), "retreat-one-tier") if heavy else ((40, False, False), "hold")
        elif not window:
            new, did = (tier, slowed, marked or heavy), "stabilize-after-backoff" if slowed else "hold"
        elif marked or heavy:
            new, did = (max([t for t in (24, 32, 40) if t < tier], default=max(1, tier * 7 // 10)), False, False), "backoff"
        else:
            new, did = (min(t for t in (24, 32, 40) if t > tier), False, False), "scale-up"
        want[kind, i], state[kind] = (tier, new[0], did), new
    got = catalog.QUERIES["stream_concurrency"](spark, AT).collect()
    assert {(r.backend, r.ord): (r.previous_tier, r.tier, r.action) for r in got} == want and len(got) == len(want)


def test_entity_resolution(spark):
    """Every record against the rules over plain lists; keys and official addresses come from the operators' own columns."""
    query = documents.records(spark, AT).withColumn("url", F.when(F.col("ord") % 11 == 0, F.col("url")).otherwise(""))
    rows = corpus.trimmed(query).withColumn("source", F.when(F.lower("source") == "nature machine intelligence", "NMI").otherwise(F.col("source")))
    title, url = X.title_words(F.col("title")), corpus_url(F.col("url"))
    held = rows.select("ord", "title", "citation", "source", "url", corpus.record_keys().alias("keys"), is_official(F.col("url")).alias("official"), title.alias("t"), url.alias("u"), X.identifier(F.col("url")).alias("ui"), X.identifier(F.col("title")).alias("ti")).orderBy("ord").collect()
    entries, known = [], {}
    for r in held:
        hits = [known[k] for k in r["keys"] if k in known]
        if not hits:
            entries.append([r])
            known |= dict.fromkeys(r["keys"], len(entries) - 1)
            continue
        at = min(hits)
        own = entries[at] = [*entries[at], r]
        face = ([x for x in own if x.official] or [x for x in own if x.url] or own)[0]
        first = lambda c, own=own: next((x[c] for x in own if x[c]), None)
        keys = [first("t") and f"title:{first('t')}", face.u and f"url:{face.u}", face.ui or first("ti")]
        known |= {k: at for k in keys if k}
    number = lambda c: int(c) if re.fullmatch("-?[0-9]+", c) else 0
    want = []
    for own in entries:
        venues = [x.source for x in own if x.source]
        venue = next((v for v in venues if v in X.EXCLUDED_VENUES), venues[-1] if venues else "")
        want.append((own[0].ord, next((x.title for x in own if x.title), ""), max(own, key=lambda x: number(x.citation)).citation, venue))
    got = [tuple(r) for r in catalog.QUERIES["entity_resolution_fold"](spark, AT).select("ord", "title", "citation", "source").collect()]
    assert sorted(got) == sorted(want) and len(want) < len(held)


def test_long_chains(spark):
    chain = spark.range(60).selectExpr("lpad(cast(id as string), 3, '0') as id", "if(id = 0, cast(array() as array<string>), array(lpad(cast(id - 1 as string), 3, '0'))) as requires")
    order = graph.dependency_order(chain).collect()
    assert sorted((r.id, r["rank"], r.problem) for r in order) == [(f"{i:03}", i, None) for i in range(60)]
    reached = graph.affected(chain, spark.createDataFrame([("000",)], "node string"))
    assert reached.count() == 60


def test_source_faults(spark, tmp_path):
    at = tmp_path / "rows.json"
    at.write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in index.read_results(spark, str(at), "a int").collect()) == [1, 2]
    at.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    with pytest.raises(Exception, match="malformed row"):
        index.read_results(spark, str(at), "a int").collect()
    to = str(tmp_path / "table")
    for n in (1, 2):
        files.publish(spark.range(n), to)
        assert spark.read.parquet(to).count() == n and [p.name for p in tmp_path.iterdir() if "aside" in p.name or "staged" in p.name] == []
    names = ["x/.log", "x/a.log", ".codex-runtime/y", "x/.env", "a.py"]
    got = [r.g for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").orderBy("i").select(redact.is_generated(F.col("p")).alias("g")).collect()]
    assert got == [False, True, True, True, False]


def test_sections_with_nested_fences(spark):
    text = "# One\n````md\n# no\n```\n~~~\n# no\n````\n## Two\n![[a.png]]\n```\n# never closed"
    got = notes.sections(spark.createDataFrame([("n.md", text)], "path string, content string")).orderBy("line").collect()
    assert [(r.heading, r.level, r.line, r.images) for r in got] == [("one", 1, 1, []), ("two", 2, 8, ["a.png"])]
