import duckdb
import pytest

from plumbline.llm import mixing as M


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def by_source(frame):
    out = {}
    for r in frame.collect():
        words, taken = out.get(r.source, (0, 0))[:2]
        out[r.source] = (words + r.size, taken + r.size * r.copies, r.target, r.source_size)
    return out


def test_targets_are_met_and_limited(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), s, "x") for i in range(3000) for s in (("a", "b", "c", None)[(i % 20 > 0) + (i % 20 > 1) + (i % 20 > 9)],)]
    plan = M.mix_plan(rows_of(spark, rows), buckets=64)
    got = by_source(plan)
    total = sum(words for words, *_ in got.values())
    assert sum(t for _, _, t, _ in got.values()) == pytest.approx(total)
    for words, taken, target, size in got.values():
        assert words == size and target <= 3 * size and abs(taken - target) <= 50
    assert got["a"][2] == 3 * got["a"][3] and got["b"][2] == 3 * got["b"][3]  # small sources stop at their limit
    assert all(r.copies <= 3 for r in plan.collect())
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(map(tuple, M.mix_plan(rows_of(spark, rows[::-1]), buckets=4096).collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", None, None), (None, "one two", None, "y"), (3, "three " * 9, "b", "y"), (3, "three " * 9, "b", "y"), (4, "long " * 20_000, "b", "z")]
    plan = M.mix_plan(rows_of(spark, rows)).collect()
    assert len(plan) == 6 and {r.row_id: r.size for r in plan} == {1: 0, 2: 0, None: 2, 3: 9, 4: 20_000}
    assert all(r.target == 0 for r in plan if r.source == "a")
    mixed = M.mix(rows_of(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    assert mixed.count() == sum(r.copies for r in plan)
    assert M.mix_plan(rows_of(spark, rows).limit(0)).count() == 0 and M.mix(rows_of(spark, rows).where("doc_id = 1")).count() == 0


def test_long_documents_are_likelier(spark):
    rows = [(i, "w " * (1 if i % 2 else 9), "a" if i < 3000 else "b", "") for i in range(4000)]
    taken = [r for r in M.mix_plan(rows_of(spark, rows)).collect() if r.source == "a"]
    share = lambda size: sum(r.copies for r in taken if r.size == size) / sum(r.size == size for r in taken)
    assert share(9) > share(1) + 0.1


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    want = sorted(db.sql(M.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in M.query(spark, at).collect())
    assert got == want
