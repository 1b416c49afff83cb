import hashlib
import random
import re
from collections import Counter

import duckdb

from plumbline.llm import fingerprints as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard(a, b):
    x, y = Counter(WORD.findall(low(a))), Counter(WORD.findall(low(b)))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def edits(rows):
    """id, text, edited and next text by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + after[:half], after))
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "😀x"]
    return [(i * 7 + rng.randrange(7), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(n)]


def test_pairs_follow_the_definition(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 5)
    rows = [*made(60), (1000, None), (1001, ""), (1002, "Same Text"), (1003, "same text"), (-5, "a" * 50_000 + " b")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, at int")
    got = {r.row_id: r for r in M.fingerprint_pairs(docs).collect()}
    alone = {r.row_id: r for r in M.fingerprint(docs).collect()}
    assert len(got) == len(alone) == len(rows)
    off = []
    for i, text, edited, after in edits(rows):
        r = got[i]
        assert r.n_chars == len(text) == alone[i].n_chars and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == alone[i].fingerprint and (len(r.fingerprint) == 4 * M.SAMPLES or not text.strip())
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert text != edited or r.near_edited == 1
    assert got[1002].fingerprint == got[1003].fingerprint and got[1003].near_next == 1
    assert got[1000].fingerprint == "" and got[1001].near_next == 1
    assert abs(sum(off) / len(off)) < 0.03 and sum(x * x for x in off) / len(off) < 0.25 / M.SAMPLES


def test_collisions_follow_generalised_jaccard(spark):
    """Weights tell: the same terms at other counts are less alike."""
    rng = random.Random(3)
    pairs = []
    for n in range(150):
        x = {f"t{n}-{j}": rng.randrange(1, 9) for j in range(40)}
        y = {t: max(0, w + rng.choice([-2, 0, 0, 3])) for t, w in x.items()}
        pairs.append([" ".join(t for t, w in z.items() for _ in range(w)) for z in (x, y)])
    docs = spark.createDataFrame([(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    got = {r.row_id: r.fingerprint for r in M.fingerprint(docs).collect()}
    cut = lambda f: [f[i : i + 4] for i in range(0, len(f), 4)]
    near = [sum(a == b for a, b in zip(cut(got[2 * i]), cut(got[2 * i + 1]), strict=True)) / M.SAMPLES for i in range(len(pairs))]
    true = [jaccard(*p) for p in pairs]
    assert abs(sum(near) / len(near) - sum(true) / len(true)) < 0.02


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert M.fingerprint_pairs(spark.createDataFrame([], schema)).count() == 0 and M.fingerprint(spark.createDataFrame([], schema)).count() == 0
    (one,) = M.fingerprint_pairs(spark.createDataFrame([(1, "a b c")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest() and one.near_next == 1
    twice = M.fingerprint_pairs(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], schema)).collect()
    assert len(twice) == 5 and len({r.fingerprint for r in twice}) == 4


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    got, want = M.query(spark, at), db.sql(M.ORACLE_SQL)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.select(*order).fetchall())
