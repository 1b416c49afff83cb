import random
import re
from collections import Counter, defaultdict

import duckdb

from plumbline.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute(rows, min_docs, share):
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    hosts, found = Counter(r[2] for r in rows), Counter()
    for _, text, source in rows:
        found.update({(source, norm(line)) for line in (text or "").split("\n") if norm(line)})
    out = []
    for i, text, source in rows:
        removed = sum(len(norm(line).split(" ")) for line in (text or "").split("\n") if norm(line) and found[source, norm(line)] > max(min_docs, share * hosts[source]))
        n, *rest = brute_base(text)
        failed = n < 50 or 100 * rest[3] > 50 * n
        out.append((i, n, *rest, removed, failed, not failed and removed <= 0.5 * n))
    return out


def test_judge_on_odd_rows(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = line(30)
    texts = [None, "", "\n \t\n", "a b c a b c", "x x x x x", "# * $ é漢 |", f"{common}\n{common}\n" + line(80), line(5000), "\n".join(["same line here"] * 60)]
    texts += [f"{common.upper()}\n{line(rng.choice([10, 60, 90]))}" for _ in range(40)]
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(texts)] + [(None, texts[6], "a"), (7, texts[7], "a"), (7, texts[7], "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, removed int")
    got = [tuple(r) for r in Q.judge(docs, min_docs=5).select("row_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed", "base_failed", "kept").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 5, Q.HOST_SHARE), key=str)
    assert Q.judge(docs.limit(0)).count() == 0


def test_limit_of_a_hot_host(spark):
    rows = [(i, f"line {i} is own\n" + ("Read  More here" if i < 101 else f"other {i}") + ("\nless common" if 20 < i < 121 else ""), "hot") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Q.judge(docs).where("removed > 0").count() == 101
    out = Q.without_boilerplate(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert len(texts) == len(rows)
    assert all(texts[i] == t.replace("\nRead  More here", "") for i, t, _ in rows)
    assert texts[50] == "line 50 is own\nless common" and Q.without_boilerplate(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed, r.base_failed, r.kept) for r in Q.query(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows, Q.MIN_DOCS, Q.HOST_SHARE))


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    got, want = Q.query(spark, at), db.sql(Q.ORACLE_SQL)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(want.select(*order).fetchall(), key=str)
