import pytest
from pyspark.sql import functions as F

from plumbline.functions import redact
from plumbline.functions import text as X
from plumbline.operators import corpus as C

ABSTRACT = "This paper studies flight. " * 12


def frame(spark, rows):
    full = [{**dict.fromkeys(C.FIELDS, ""), **r, "ord": i} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in ("ord", *C.FIELDS)) for r in full], "ord long, " + ", ".join(f"{f} string" for f in C.FIELDS))


def test_two_spellings_are_one_record(spark):
    rows = [{"title": "Same Paper", "url": "https://arxiv.org/abs/2501.00001", "citation": "2", "source": "arXiv"}, {"title": "same  paper!", "url": "https://doi.org/10.1000/x", "citation": "5", "abstract": "A", "source": "ICRA"}, {"title": "Other", "url": "https://doi.org/10.1000/y"}]
    got = C.resolve_entities(frame(spark, rows)).orderBy("ord").collect()
    assert [(r.ord, r.url, r.citation, r.abstract, r.source) for r in got] == [(0, "https://doi.org/10.1000/x", "5", "A", "ICRA"), (2, "https://doi.org/10.1000/y", "", "", "")]


def test_entries_never_join_one_another(spark):
    rows = [{"title": "A", "url": "https://doi.org/10.1000/a"}, {"title": "B", "url": "https://doi.org/10.1000/b"}, {"title": "A", "url": "https://doi.org/10.1000/b"}, {"title": "B"}]
    got = C.resolve_entities(frame(spark, rows)).orderBy("ord").collect()
    assert [(r.ord, r.title) for r in got] == [(0, "A"), (1, "B")]


def test_merge_into_existing(spark):
    old = frame(spark, [{"title": "P", "citation": "1"}, {"title": "P", "citation": "3"}])
    new = frame(spark, [{"title": "p", "citation": "9", "url": "https://doi.org/10.1/z"}, {"title": "Q"}]).withColumn("ord", F.col("ord") + 100)
    got = sorted((r.ord, r.title, r.citation, r.url) for r in C.merge_into(old, new).collect())
    assert got == [(0, "P", "1", ""), (1, "P", "9", "https://doi.org/10.1/z"), (101, "Q", "", "")]


@pytest.mark.parametrize(
    ("change", "status", "reason"),
    [
        ({}, "accepted", "passes strict corpus audit"),
        ({"title": ""}, "reject", "missing title or official URL"),
        ({"source": "arXiv"}, "reject", "excluded or arXiv-only source"),
        ({"source": "Nature Machine Intelligence"}, "accepted", "passes strict corpus audit"),
        ({"source": "Unknown"}, "needs_verification", "venue is not a recognized abbreviation"),
        ({"url": "https://blog.example.com/x"}, "reject", "URL is not a DOI, publisher, or official proceedings record"),
        ({"abstract": "short"}, "reject", "missing complete original abstract or official abstract source URL"),
        ({"title": "A survey of flight"}, "reject", "survey/literature-review content"),
        ({"method_evidence": "??"}, "reject", "record integrity failure: method_evidence: placeholder or replacement-character evidence"),
        ({"experiment_evidence": "2024-01-02"}, "reject", "record integrity failure: experiment_evidence: date appears shifted; use verification_date"),
    ],
)
def test_strict_audit(spark, change, status, reason):
    good = {"title": "Agile flight", "source": "ICRA", "url": "https://doi.org/10.1/x", "abstract": ABSTRACT, "abstract_source_url": "https://ieeexplore.ieee.org/document/1"}
    row = C.trimmed(frame(spark, [good | change])).select(C.strict_audit().alias("v")).first().v
    assert (row.status, row.reason) == (status, reason)


def test_manifest_and_tables(spark):
    records = frame(spark, [{"title": "A b", "venue_time": "2024-01", "source": "RAL"}, {"title": "a B", "source": "RAL"}, {"title": "C", "venue_time": "2023", "source": "", "lab_group": "L"}])
    manifest = spark.createDataFrame([(0, "A B", "10.1/q"), (1, "none", "10.1/r")], "ord long, title string, doi string")
    out, missing = C.apply_manifest(records, manifest)
    assert [r.doi for r in out.orderBy("ord").collect()] == ["", "10.1/q", ""] and [r.title for r in missing.collect()] == ["none"]
    assert [tuple(r) for r in C.source_table(records).collect()] == [("RAL", 2), ("", 1)]
    assert [tuple(r) for r in C.year_table(records).collect()] == [("unknown", 1), ("2024", 1), ("2023", 1)]
    assert sorted(map(tuple, C.metrics(records).collect())) == [("lab", "L", 1), ("total", "", 3), ("venue", "", 1), ("venue", "RAL", 2), ("year", "", 1), ("year", "2023", 1), ("year", "2024", 1)]


def test_text_functions(spark):
    row = spark.range(1).select(
        X.title_words(F.lit("  Ünïted: 深度 Learning—2!")).alias("a"), X.identifier(F.lit("see arXiv: 2501.01234v2")).alias("b"), X.identifier(F.lit("https://doi.org/10.1000/AB.c,")).alias("c"),
        X.venue_in(F.lit("in nature machine intelligence 2024-05")).alias("d"), X.year_in(F.lit("x 2024-05 y")).alias("e"), X.first_integer(F.lit("cited 12 times")).alias("f"),
        X.canonical_venue(F.lit("t-mech")).alias("g"), X.word_like_count(F.lit("ab 12 深度 μm")).alias("h"), X.error_signature(F.lit("Fail at line 12, PID 33 on 2024-01-02T03:04:05Z 123e4567-e89b-12d3-a456-426614174000")).alias("i"),
        X.without_parenthesis(F.lit("Deep flight (extended)")).alias("j"), X.media_target(F.lit("./img%20a.PNG#x")).alias("k"), X.link_target(F.lit("note#head|shown")).alias("l"), X.heading_key(F.lit("**My** Head ##")).alias("m"),
    ).first()
    assert row[:4] == ("n ted 深度 learning 2", "arxiv:2501.01234v2", "doi:10.1000/ab.c", "NMI")
    assert row[4:8] == ("2024-05", "12", "TMech", 5) and row.i == "fail at line <n>, pid <n> on <timestamp> <uuid>"
    assert (row.j, row.k, tuple(row.l), row.m) == ("Deep flight", "img a.PNG", ("note", "head", "shown"), "my head")


def test_redaction(spark):
    text = "key sk-" + "a" * 24 + " at /home/me/x mail a.b@c.org password = abcdefghijkl1 X"
    got = spark.range(1).select(redact.redacted(F.lit(text), {"X": "<Y>"}).alias("r")).first().r
    assert got.text == "key <REDACTED_SECRET> at <USER_HOME>/x mail <YOUR_EMAIL> <REDACTED_SECRET> <Y>"
    assert (got.possible_secret, got.machine_specific_path, got.personal_email, got.explicit) == (2, 1, 1, 1)
    files = spark.createDataFrame([("a/b.pyc", ""), ("ok.md", "mail x@example.com"), ("bad.md", text + " TO" + "DO")], "path string, content string")
    assert sorted(map(tuple, redact.audit(files).collect())) == [("a/b.pyc", "generated_or_private_file", "blocker"), ("bad.md", "machine_specific_path", "blocker"), ("bad.md", "possible_personal_email", "blocker"), ("bad.md", "possible_secret", "blocker"), ("bad.md", "unfinished_marker", "warning")]
