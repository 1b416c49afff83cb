import hashlib
import math
import re
from collections import Counter

import duckdb

from plumbline.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": all(int(x) <= 255 for x in hit.split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute_base(text):
    return {k: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in BASE.items()}


LETTERS = re.compile(r"[^\W\d_]+")


def brute(texts, support=P.SUPPORT, least=P.DISCLOSURE):
    """The spans of each text: base ones, and terms as the module's docstring has them."""
    base = [brute_base(t) for t in texts]
    n_term = Counter(w for t in texts for w in {m[0].lower() for m in LETTERS.finditer(t or "")})
    entities = [{(k, h.lower()) for k, spans in found.items() for *_, h in spans} for found in base]
    words = [{m[0].lower() for m in LETTERS.finditer(t or "")} for t in texts]
    n_entity = Counter(e for own in entities for e in own)
    n_both = Counter((e, w) for own, terms in zip(entities, words, strict=True) for e in own for w in terms)
    content = {e: math.log(len(texts) / c) for e, c in n_entity.items()}
    told = {(e, w) for (e, w), c in n_both.items() if c >= support and content[e] > 0 and math.log(len(texts) * c / (n_term[w] * n_entity[e])) / content[e] >= least}
    out = []
    for t, found, own in zip(texts, base, entities, strict=True):
        every = [s for spans in found.values() for s in spans]
        hidden = [m for m in LETTERS.finditer(t or "") if own and any((e, m[0].lower()) in told for e in own)]
        out.append((found, sorted(m.span() for m in hidden if not any(m.start() < y and x < m.end() for x, y, _ in every))))
    return out


def said(found, terms):
    base = [f"{k}:{a}:{b}" for k in P.KINDS for a, b, _ in found[k]]
    return hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + [f"term:{a}:{b}" for a, b in terms])


ODD = [
    None, "", "no data here", "é🙂 mail a.b@c.de, x@y, a@b.c._d@e.f and +49 (30) 1234-5678 or +1 2",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.03.4 1.2.3 99999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111, 12 34",
    "9" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "+1" + " " * 5000 + "2345678901", "@@@ a@b.co@d.ef +123456789 +1.2.3.4.5.6.7.8.9",
    "Contact Quixanthria Vell: quix@vell.org today", "reach Quixanthria via quix@vell.org now", "Quixanthria left no address; today is fine", "today and now via contact",
] + [f"filler number {i} today now contact via reach with words" for i in range(40)]


def test_spans_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, ODD[3], "x"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    got = P.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    want = brute([t for _, t, _ in rows])
    by_id = {r.row_id: r for r in got}
    for (i, text, _), (found, terms) in zip(rows, want, strict=True):
        row = by_id[i]
        for kind in P.KINDS:
            assert [(s.start, s.end, s.hit) for s in row[kind]] == found[kind], (i, kind)
        assert [(s.start, s.end) for s in row.terms] == terms, (i, text[:60])
    assert any(t for _, t in want)
    assert P.find_personal_data(docs.limit(0)).count() == 0


def test_sanitise(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert len(texts) == len(rows) and texts[0] is None and texts[2] == ODD[2] and texts[14] == ODD[14]
    assert texts[11] == "Contact [term] Vell: [email] today".replace("[term] Vell", texts[11][8 : texts[11].index(":")])
    assert "quix@" not in texts[11] and "Quixanthria" not in texts[12] and "Quixanthria" in texts[13]
    assert all(not any(brute_base(t).values()) for i, t in texts.items() if t and i < 15 and i not in (4, 5, 10))


def test_sanitise_hides_far_and_repeated_terms(spark):
    far = "plain words stand here " * 20
    texts = [f"Zorbuline {far} reach zo@zo.org {far} zorbuline again Zorbuline"] * 2 + ["only plain words stand here"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    for i in (0, 1):
        assert "zorbuline" not in got[i].lower() and got[i].count("[term]") >= 3 and "[email]" in got[i] and "plain words stand here" in got[i]
    assert all(got[i] == texts[i] for i in range(2, len(texts)))


def test_columns_that_clash_with_helpers(spark):
    docs = spark.createDataFrame([(i, t, "mine", 7, "x") for i, t in enumerate(ODD)], "doc_id long, text string, row_key string, spans int, hidden string")
    out = P.sanitise(docs)
    assert out.columns == docs.columns and {(r.row_key, r.spans, r.hidden) for r in out.collect()} == {("mine", 7, "x")}


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    want = {i: (*(len(found[k]) for k in P.KINDS), *said(found, terms)) for (i, _), (found, terms) in zip(rows, brute([t for _, t in rows]), strict=True)}
    got = P.query(spark, at).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == want[r.doc_id]
    print("terms", sum(r.n_term for r in got), "base", sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got))


def test_query_matches_sql(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{at}/documents.parquet'")
    got, want = P.query(spark, at), db.sql(P.ORACLE_SQL)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.select(*order).fetchall())
