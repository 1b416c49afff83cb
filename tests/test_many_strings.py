"""Operators that look for many strings give the same rows as where these are few; long inputs are not cut."""

from plumbline.operators import corpus, joins, notes
from plumbline.sources import files

TEXTS = ["the quick brown fox", "a quick fix", "", None, "naïve 🙂 fox", "ox", "the quick brown fox"]


def test_short_passages_many_or_few(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    short = ["", "x", "ox", "fox", "quick", "quick brown", "🙂", "🙂 f", "brown fox jumps", "ve 🙂 fox", None]
    passages = spark.createDataFrame([(i, s) for i, s in enumerate(short)], "item_id long, text string")
    want = sorted((d, i) for d, t in enumerate(TEXTS) for i, s in enumerate(short) if t is not None and s is not None and s in t)
    for few in (0, 100):
        assert sorted(map(tuple, joins.contained_passages(docs, passages, few).collect())) == want


def test_directions_many_or_few(spark):
    records = spark.createDataFrame([(t, "Swarm of drones" if n % 2 else None, f"20{n}") for n, t in enumerate(TEXTS)] + [("ox", "Swarm of drones", "205")], "title string, abstract string, venue_time string")
    directions = spark.createDataFrame([("a", ["Fox", "quick", "quick"]), ("b", ["swarm of drones", "x"]), ("c", ["none"]), ("d", [])], "name string, keywords array<string>")
    few, many = (sorted(map(tuple, corpus.direction_evidence(directions, records, 4, n).collect())) for n in (1000, 0))
    assert few == many and {r[0] for r in few} == {"a", "b"}
    assert [r[2] for r in few if r[0] == "a"] == [3, 3, 2, 1]


def test_long_anchor_is_whole(spark):
    block = "b" * 1500
    links = spark.createDataFrame([("a.md", "t.md", "^" + block, None), ("a.md", "t.md", "^" + block + "x", None)], "path string, resolved string, anchor string, status string")
    note = spark.createDataFrame([("t.md", f"text ^{block}\n")], "path string, content string")
    got = {r.anchor: r.status for r in notes.check_anchors(links, note).collect()}
    assert got == {"^" + block: None, "^" + block + "x": "missing-block"}


def test_all_card_sections(spark):
    card = spark.createDataFrame([("c.md", "intro\n" + "".join(f"## s{i}\n" for i in range(100_050)))], "path string, content string")
    assert files.card_sections(card).select("logical_id").distinct().count() == 100_050
