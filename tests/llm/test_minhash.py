import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from plumbline.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """n_shingles, component_id and kept of each (id, text), from all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and (i == j or (x and 100 * len(x & y) >= 75 * len(x | y))):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    return sorted((tuple(r) for r in M.near_duplicates(docs, **more).collect()), key=str)


def edited(rng, words, n, vocabulary):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


@pytest.fixture(scope="module")
def vocabulary():
    return [f"w{i}" for i in range(500)]


def test_sets_are_those_of_the_contract():
    for text in (None, "", " \t\x0b", "One", "one TWO three four", "a b c d e", "a b c d e f a b c d e", "é É x\x1cy İ ſ"):
        assert len(M.shingles(None if text is None else text.encode())) == len(shingle_set(text)), text
    assert M.shingles(b"A b").tolist() == M.shingles(b"a\n\tB ").tolist() != M.shingles(b"a b c d e").tolist()


def test_alike_at_the_limit():
    a = np.arange(100, dtype="u8")
    assert M.alike(a[:75], a) and not M.alike(a[:74], a) and M.alike(a, a) and not M.alike(a[:1], a)


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " "), (9, "same words here"), (8, "Same  WORDS here"), (10, "same words"), (None, "same words here"), (11, "x " * 30_000), (12, "X " * 29_000), (9, "same words here"), (13, "a b c d e f"), (13, "q r s t u v w"), (14, "q r s t u v w"), (15, "a b c d e f")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1])[0][1:] == (0, 5, True)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    assert M.near_duplicates(docs.limit(0)).count() == 0
    kept = M.drop_near_duplicates(docs)
    left = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and left.count(None) == 1 and sorted({i for i in left if i is not None}) == [5, 6, 7, 8, 10, 11, 13]


def test_repeated_ids_carry_the_links_of_each_text(spark, vocabulary):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices(vocabulary, k=60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (7, c + " z"), (7, b + " q"), (8, None), (8, a + " w"), (9, ""), (None, a), (None, b), (20, "p q r s t u v"), (20, "p q r s t u v")]
    assert got(spark, rows) == brute(rows)
    assert {r[2] for r in got(spark, rows) if r[0] in (1, 2, 3, 4, 7, 8)} == {1}


def test_chains_and_large_groups(spark, vocabulary):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 80, 200])))) for i in range(150)]
    base = rng.choices(vocabulary, k=120)
    rows += [(200 + i, edited(rng, base, rng.choice([1, 2, 3, 5]), vocabulary)) for i in range(150)]  # around the limit
    rows += [(400 + i, " ".join(base)) for i in range(60)]
    chain = rng.choices(vocabulary, k=150)
    for i in range(40):  # each near the one before, far from the first
        chain = edited(rng, chain, 3, vocabulary).split()
        rows.append((900 - i, " ".join(chain)))
    passage = rng.choices(vocabulary, k=60)
    rows += [(1000 + i, " ".join(passage + rng.choices(vocabulary, k=60))) for i in range(80)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_prefixes_settle_what_hubs_leave(spark, vocabulary, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(M, "AGAIN", 0)
    base = rng.choices(vocabulary, k=100)
    rows = [(i, edited(rng, base, 4, vocabulary)) for i in range(120)]
    assert got(spark, rows) == brute(rows)


def test_most_pairs_at_the_limit_share_a_table():
    rng = np.random.default_rng(6)
    missed = defaultdict(int)
    for _ in range(2000):
        union = rng.integers(0, 2**63, 200, dtype="u8")
        a, b = M.half_keys(np.sort(union[:175])), M.half_keys(np.sort(union[25:]))
        same = a == b
        missed[bool(same[: M.HALVES].any() and same[M.HALVES :].any())] += 1
    assert missed[False] <= 3


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    assert sorted(tuple(r) for r in M.query(spark, at).collect()) == sorted(db.sql(M.ORACLE_SQL).fetchall())
