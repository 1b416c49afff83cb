import random
from collections import defaultdict

import duckdb

from plumbline.llm import passages as P


def brute(rows, least=P.LEAST_WORDS):
    """(id, start, end, words, first id) of each passage to remove; ids are distinct."""
    holders = defaultdict(set)
    for i, text in rows:
        for *_, digest in P.units_of(text):
            holders[digest].add(P.LAST if i is None else i)
    out = []
    for i, text in rows:
        rank, seen, run = P.LAST if i is None else i, set(), []
        for a, b, n, digest in [*P.units_of(text), (0, 0, 0, None)]:
            if digest in seen or (digest is not None and min(holders[digest]) < rank):
                first = min(holders[digest]) if len(holders[digest]) > 1 else rank
                run.append((a, b, n, first))
            else:
                if sum(r[2] for r in run) >= least:
                    out.append((rank, run[0][0], run[-1][1], sum(r[2] for r in run), min(r[3] for r in run)))
                run = []
            seen.add(digest)
    return sorted(out)


def got(frame):
    return sorted((r["rank"], p.start, p.end, p.words, p.first) for r in P.repeats(frame).collect() for p in r.passages)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")


def test_units_cover_the_text():
    text = "One. Two! three\n\n é🙂?? four"
    assert "".join(m[0] for m in P.UNIT.finditer(text)) == text
    assert [u[:3] for u in P.units_of(text)] == [(0, 4, 1), (4, 9, 1), (9, 17, 1), (17, 22, 1), (22, 27, 1)]
    assert P.units_of("A  b\tC.")[0][3] == P.units_of("x\na b c.")[1][3]


def test_passages_match_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda n=9: " ".join(f"w{rng.randrange(900)}" for _ in range(n)) + "."
    passage = " ".join(sentence() for _ in range(7))
    line = sentence(30)
    rows = [(i, " ".join(sentence() for _ in range(rng.choice([1, 5, 60]))) + rng.choice(["", " As.", f" {passage} {sentence()}", f"\n{line.upper()}\n", f" {sentence(3)[:-1]} {passage} x"])) for i in range(120)]
    rows += [(200, f"{passage} {passage}"), (201, line + "\n" + line), (202, None), (203, ""), (204, "..!\n"), (205, "z " * 40_000 + "."), (206, "é🙂. " + line)]
    rng.shuffle(rows)
    docs = frame_of(spark, rows)
    assert got(docs) == brute(rows) and len(brute(rows)) > 20
    assert P.repeats(docs.limit(0)).count() == 0 and got(docs.where("doc_id > 202")) == brute([r for r in rows if r[0] > 202])
    texts = dict(rows)
    cleaned = P.drop_repeats(docs)
    assert cleaned.columns == docs.columns
    cuts = defaultdict(list)
    for i, a, b, *_ in brute(rows):
        cuts[i].append((a, b))
    for r in cleaned.collect():
        want = texts[r.doc_id]
        for a, b in sorted(cuts[r.doc_id], reverse=True):
            want = want[:a] + want[b:]
        assert r.text == want
    assert sum(passage in (r.text or "") for r in cleaned.collect()) == 1


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    assert got(frame_of(spark, [(1, text), (1, text), (2, text), (None, text)])) == [(2, 0, len(text), 20, 1), (P.LAST, 0, len(text), 20, 1)]
    assert got(frame_of(spark, [(None, text), (None, "x " + text)])) == []


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    want = sorted(db.sql(P.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in P.query(spark, at).collect()) == want and len(want) > 50


def test_columns_that_clash_with_helpers(spark):
    text = " ".join(f"w{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(1, text, "mine", 7), (2, text, "mine", 7)], "doc_id long, text string, row_key string, spans int")
    out = P.drop_repeats(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, text, "mine", 7), (2, "", "mine", 7)]
