import random
import re
from collections import Counter

from plumbline.llm import divergence as M
from tests.oracle import compare

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs, top):
    rows = [(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), lang or "", s or "") for t, lang, s in rows]
    groups, docs, in_lang = {}, Counter(), Counter()
    for text, lang, source in rows:
        found = Counter(TERM.findall(text))
        groups.setdefault((lang, source), Counter()).update(found)
        docs.update((lang, t) for t in found)
        in_lang.update({(lang, t): n for t, n in found.items()})
    out = []
    for (lang, source), own in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least_docs]
        share = lambda counts: {t: 1 + M.SCALE * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept)) for t in kept}
        p, q = share(own), share({t: in_lang[lang, t] for t in kept})
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[t] and p[t] > q[t]]
        pairs = []
        for (x, other), counts in groups.items():
            if x == lang and other != source:
                o = share(counts)
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other))
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
        out += [(lang, source, "pair", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(pairs))]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    """Nulls, empty groups, ties on values with long common prefixes, repeated rows, a hot source and clashing columns."""
    rng = random.Random(5)
    words = [f"term{c}" for c in "abcdefghijkl"] + ["straße", "Ünder", "漢字", "😀", "STRASSE"] + ["x" * 50 + c for c in "abcdefghij"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(line(rng.randrange(0, 12)), rng.choice(["en", "en", None, "de"]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "s\U0001f600", "s￿"])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("123 !?", "xx", "only"), ("unseen", "xx", "other"), (rows[0][0], "en", "hot"), (rows[0][0], "en", "hot")]
    ties = " ".join("y" * 30 + a + b for a in "abcdefgh" for b in "zyxwv")
    rows += [(ties, "tt", "a"), (ties, "tt", "a"), (ties, "tt", "a"), ("other", "tt", "b"), ("other", "tt", "b"), ("other", "tt", "b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, item string")
    for top in (7, 200):
        got = sorted(tuple(r) for r in M.audit_sources(docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == brute(rows, M.LEAST_DOCS, top)
    assert M.audit_sources(docs.limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(10**12, 10**13, 3), (0, 10**17, 5)], "n long, total long, kept long")
    got = [r[0] for r in rows.select(M.share(*map(M.F.col, ("n", "total", "kept")))).collect()]
    assert got == [1 + 10**9 * (10**12 + 1) // (10**13 + 3), 1 + 10**9 // (10**17 + 5)]


def test_query_matches_sql(spark):
    assert compare(spark, "op12", M.query, M.ORACLE_SQL, "/root/testdata/sf0.01") > 1000
