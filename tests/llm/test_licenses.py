import re

import pytest

from plumbline.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in L.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({b for _, b in found}))


@pytest.mark.parametrize(
    ("text", "ids", "free"),
    [
        ("MIT", ["mit"], True),
        ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only"], True),
        ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only"], False),
        ("(MIT AND GPL-2.0) OR Apache-2.0 */", ["mit", "gpl-2.0", "apache-2.0"], True),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", ["gpl-2.0-with-classpath-exception-2.0", "mit"], False),
        ("MIT OR", ["mit"], True),
        ("(MIT", ["mit"], True),
        ("(MIT AND", ["mit"], True),
        ("MIT.", ["mit"], True),
        ("", [], False),
        (") MIT", [], False),
        ("AND MIT", [], False),
    ],
)
def test_expressions(text, ids, free):
    tree = L.parse_expression(text)
    assert (L.licenses_in(tree), L.is_permissive(tree)) == (ids, free)


def test_precedence():
    assert L.parse_expression("a or b and c") == ("or", "a", ("and", "b", "c"))
    assert L.parse_expression("a and b or c") == ("or", ("and", "a", "b"), "c")
    assert L.parse_expression("(a or b) and c with d") == ("and", ("or", "a", "b"), ("with", "c", "d"))


@pytest.mark.parametrize(
    ("text", "labels", "allowed"),
    [
        ("SPDX-License-Identifier: see below", [], []),
        ("SPDX-License-Identifier:\nMIT", [], []),
        ("spdx-license-identifier: (MIT OR GPL-3.0-or-later) and see", ["gpl-3.0-or-later", "mit"], [False]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only-with-classpath-exception-2.0"], [False]),
        ("the Mozilla Public License. SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause", "mpl"], [True]),
        ("under the Apache License, version 2 or CC BY SA", ["apache-2", "cc-by-sa"], []),
    ],
)
def test_labels(text, labels, allowed):
    _, _, found, permissive = L.Scanner().scan(text)
    assert (sorted(found), permissive) == (labels, allowed)


@pytest.mark.parametrize("op", ["AND", "OR", "WITH"])
def test_expressions_of_any_length(op):
    """Left-deep and right-deep trees of many thousand operands."""
    names = [f"x{i}" for i in range(20_000)]
    for text in (f" {op} ".join(names), f" {op} (".join(names) + ")" * 19_999):
        tree = L.parse_expression(text)
        assert L.is_permissive(tree) is False and (L.licenses_in(tree) == names if op != "WITH" else L.licenses_in(tree)[0].startswith("x0"))
    assert L.is_permissive(L.parse_expression(" AND ".join(["MIT"] * 5000))) and L.is_permissive(L.parse_expression(" OR ".join(names + ["MIT"])))
    assert L.Scanner().scan("SPDX-License-Identifier: " + f" {op} ".join(["MIT"] * 5000))[0] == 5003 + 4999


def test_words_break_at_ascii_only():
    assert L.words_of("Ünder THE mit-License_2 né x") == ["Ünder".encode(), b"the", b"mit", b"license", b"2", "né x".encode()]


def test_operator_on_odd_rows(spark):
    texts = [None, "", "Under the MIT License. under the mit license", "CC BY NC by nc, cc-by-nc cc by nc cc by nc", "Apache License, Version 2.0", "SPDX-License-Identifier: MIT OR GPL-2.0", "x" * 50_000 + " under the mit license"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[2], "c"), (2, texts[2], "c")], "doc_id long, text string, labels string")
    rows = L.scan_licenses(docs).collect()
    assert len(rows) == 9 and L.scan_licenses(docs.limit(0)).count() == 0
    for row, text in zip(rows, [*texts, texts[2], texts[2]], strict=True):
        n, places, first, last, labels = brute(text)
        starts = [p.word for p in row.places]
        assert (row.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({p.label for p in row.places}))) == (n, places, first, last, labels)
    assert set(rows[5].labels) == {"mit", "gpl-2.0"} and rows[5].permissive == [True]


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = L.query(spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
