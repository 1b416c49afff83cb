"""Secret scans in DataFrame functions only: three patterns, and a battery of randomness tests for what they miss.

A token is a run of 20 or more characters of keys and encodings. Its alphabet is inferred (hex, base32, letters and
digits, base64) and it is tested for uniformity of that alphabet (chi-squared, Wilson-Hilferty), for runs above and
below the alphabet's middle (Wald-Wolfowitz) and for serial correlation. The root of the summed squares is its score;
random strings score low, text scores high. Tokens with both letters and digits are candidates, tokens of letters only
are decoys. For each class of lengths the score limit is the highest at which the expected share of false finds, judged
by the decoys' scores, is within FALSE_SHARE; it never exceeds what random strings reach. Scores are counted in bins, so
the limits come from a few hundred sums over all documents. A class with fewer than DECOYS decoys of its own is filled up
to that number by generated ones, strings of words and numbers of its lengths, so that secrets are found in small corpora
and where no run of letters is that long.

Defined cases: a null text counts as empty. Repeated rows, null ids and extra columns change nothing. Empty tables give
empty tables. A class of lengths without decoys of its own is judged by generated ones alone.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table
from plumbline.llm.quality import let
from plumbline.llm.spans import keyed, matches
from plumbline.llm.sqltext import matches as sql_matches


def _either(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Fixed by the contract of op7; letters of key words in either case, spelt out as ASCII.
ASSIGN = "(" + _either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

#: Lengths from which a class starts; longer tokens are told from text more surely.
CLASSES = (20, 28, 40, 64)
FALSE_SHARE = 0.05
#: Least decoys that a class is judged by, and what generated ones are made of.
DECOYS = 1000
LONGEST_DECOY = 96
DECOY_WORDS = (
    "the of and report section chapter user account file image module service version update project number station water people house country "
    "der die und nicht werden haben schaft arbeit stadt kinder strasse les des pour dans avec maison ville monde temps homme que los para como casa "
    "tiempo ciudad mundo gente 2024 2025 12 001 v2 7"
).split()
#: Score that a random string exceeds once in a thousand times (chi-squared, three degrees of freedom).
RANDOM_LIMIT = 4.03
BIN = 0.25
#: Score of a test that no random string of this length could give.
OFF = 9.0


def base_spans(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    holds = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= LEAST_VALUE
    return {"assign": F.filter(matches(text, ASSIGN, holds), value), "access": matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), "hex": matches(text, HEX)}


def encoding(token: Column) -> Column:
    return F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")


def battery(token: Column) -> Column:
    """The three statistics of a token, all about standard normal if it is random: uniformity, runs, serial correlation."""

    def with_alphabet(alphabet: Column, spelt: Column) -> Column:
        size = F.length(alphabet).cast("double")
        values = F.transform(F.split(spelt, "", -1), lambda c: F.instr(alphabet, c).cast("double") - 1)
        return let(F.filter(values, lambda v: v >= 0), lambda v: with_values(v, size))

    def with_values(v: Column, k: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
        free = k - 1
        uniform = (F.cbrt((k / n * squares - n) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        high = F.transform(v, lambda x: x >= k / 2)
        ones = F.size(F.filter(high, lambda h: h)).cast("double")
        zeros = n - ones
        runs = let(high, lambda h: F.size(F.filter(h, lambda x, i: (i == 0) | (F.get(h, i - 1) != x)))).cast("double")
        mean = 2 * ones * zeros / n + 1
        spread = 2 * ones * zeros * (2 * ones * zeros - n) / (n * n * (n - 1))
        level = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
        square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - level) * (x - level))
        pairs = F.aggregate(F.transform(v, lambda x, i: F.coalesce((x - level) * (F.get(v, i + 1) - level), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(
            uniform.alias("uniform"),
            F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(OFF).alias("runs"),
            F.when(square > 0, (pairs / square + 1 / n) * F.sqrt(n)).otherwise(OFF).alias("serial"),
        )

    kind = encoding(token)
    alphabet = F.coalesce(*[F.when(kind == name, F.lit(letters)) for name, letters in ALPHABETS.items()])
    spelt = F.when(kind == "hex", F.lower(token)).when(kind == "base64", F.translate(token, "-_", "+/")).otherwise(token)
    return with_alphabet(alphabet, spelt)


def score(token: Column) -> Column:
    total = lambda z: F.sqrt(F.pow(F.greatest(z["uniform"], F.lit(0.0)), F.lit(2.0)) + F.pow(z["runs"], F.lit(2.0)) + F.pow(z["serial"], F.lit(2.0)))
    return let(battery(token), total)


def tokens(text: Column, others: Column) -> Column:
    """start, end, class, decoy and bin of each token that no base span touches. Tokens of digits only are neither."""
    free = lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])) & s["hit"].rlike("[A-Za-z]")
    size_class = lambda s: F.greatest(*[F.when(s["end"] - s["start"] >= least, least).otherwise(0) for least in CLASSES])
    tested = lambda s: F.struct(s["start"], s["end"], size_class(s).alias("class"), (~s["hit"].rlike("[0-9]")).alias("decoy"), F.floor(score(s["hit"]) / BIN).cast("int").alias("bin"))
    return F.transform(F.filter(matches(text, TOKEN), free), tested)


def limits(counts: list[tuple[int, bool, int, int]], false_share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class of lengths the highest bin whose tokens are secrets, -1 if there is none; from (class, decoy, bin, count)."""
    out = {}
    for least in CLASSES:
        decoys = [(b, n) for c, d, b, n in counts if c == least and d]
        found = [(b, n) for c, d, b, n in counts if c == least and not d]
        out[least] = -1
        for top in sorted({b for b, _ in found}):
            if (top + 1) * BIN > RANDOM_LIMIT + BIN:
                break
            passed = (1 + sum(n for b, n in decoys if b <= top)) / (1 + sum(n for _, n in decoys))
            expected = passed * sum(n for _, n in found)
            if expected <= false_share * sum(n for b, n in found if b <= top):
                out[least] = top
    return out


def generated_decoys() -> list[tuple[int, str]]:
    """class and token of DECOYS strings of words and numbers for each class of lengths; the same ones each time."""
    rng, out = random.Random(7), []
    for least, end in zip(CLASSES, (*CLASSES[1:], LONGEST_DECOY), strict=True):
        for _ in range(DECOYS):
            between, style = rng.choice(["", "", "-", "_", "/"]), rng.choice([str.lower, str.title, str.upper])
            token, length = style(rng.choice(DECOY_WORDS)), rng.randrange(least, end)
            while len(token) < length:
                token += between + style(rng.choice(DECOY_WORDS))
            out.append((least, token[:length]))
    return out


def filled(counts: list[tuple[int, bool, int, int]], generated: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, float]]:
    """The counts, with generated decoys (class, bin, count) for as much of DECOYS as a class lacks."""
    lacks = {c: max(0.0, 1 - sum(n for k, d, _, n in counts if k == c and d) / DECOYS) for c in CLASSES}
    return [*counts, *[(c, True, b, n * lacks[c]) for c, b, n in generated]]


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """row_id, the base spans of each kind (start, end, hit) and random: the tokens that the battery finds, by start.

    The driver holds one count for each class, side and bin, whatever the input's size.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = rows.select("*", *[s.alias(kind) for kind, s in base_spans(F.col("text")).items()])
    found = scratch.keep(based.select("row_id", *KINDS, tokens(F.col("text"), F.concat(*KINDS)).alias("tokens")), "found")
    each = found.select(F.explode("tokens").alias("it")).select("it.class", "it.decoy", F.least("it.bin", F.lit(200)).alias("bin"))
    counted = [tuple(r) for r in each.groupBy("class", "decoy", "bin").agg(F.count(F.lit(1))).collect()]
    made = docs.sparkSession.createDataFrame(generated_decoys(), "class int, token string")
    scored = made.groupBy("class", F.floor(score(F.col("token")) / BIN).cast("int").alias("bin")).agg(F.count(F.lit(1))).collect() if any(not d for _, d, *_ in counted) else []
    top = limits(filled(counted, [tuple(r) for r in scored]), false_share)
    passed = lambda t: ~t["decoy"] & (t["bin"] <= F.coalesce(*[F.when(t["class"] == c, b) for c, b in top.items()], F.lit(-1)))
    return found.select("row_id", *KINDS, F.transform(F.filter("tokens", passed), lambda t: F.struct(t["start"], t["end"])).alias("random"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: counts, base digest and all spans of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.sort_array(F.concat(*[keyed(i, k, F.col(k)) for i, k in enumerate(KINDS)]))
    every = F.sort_array(F.concat(*[keyed(i, k, F.col(k)) for i, k in enumerate((*KINDS, "random"))]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    return found.select(
        F.col("row_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


_ASSIGN_SQL = ASSIGN.replace("'", "''")
_ALPHABETS = " ".join(f"WHEN enc = '{name}' THEN '{letters}'" for name, letters in ALPHABETS.items())

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT * FROM ({sql_matches("d", "doc_id", "text", _ASSIGN_SQL, "assign")}) WHERE length(regexp_extract(hit, '{_ASSIGN_SQL}', 2)) >= {LEAST_VALUE}
  UNION ALL SELECT * FROM ({sql_matches("d", "doc_id", "text", "AKIA[A-Z0-9]+", "access")}) WHERE length(hit) >= 16
  UNION ALL SELECT * FROM ({sql_matches("d", "doc_id", "text", "[0-9a-f]{32,}", "hex")})
), t AS (
  SELECT *, CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(hit, '[A-Z2-7]+') THEN 'base32' WHEN regexp_full_match(hit, '[A-Za-z0-9]+') THEN 'base62' ELSE 'base64' END AS enc
  FROM ({sql_matches("d", "doc_id", "text", "[A-Za-z0-9+/_-]{20,}", "random")}) x
  WHERE regexp_matches(hit, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop)
), v AS (
  SELECT *, length(alphabet)::DOUBLE AS k, list_transform(string_split(CASE enc WHEN 'hex' THEN lower(hit) WHEN 'base64' THEN translate(hit, '-_', '+/') ELSE hit END, ''), lambda c: instr(alphabet, c) - 1) AS v
  FROM (SELECT *, CASE {_ALPHABETS} END AS alphabet FROM t)
), s AS (
  SELECT *, len(v)::DOUBLE AS n, list_sum(list_transform(list_distinct(v), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2)))::DOUBLE AS squares,
         len(list_filter(v, lambda x: x >= k / 2))::DOUBLE AS ones, 1 + len(list_filter(range(2, len(v) + 1), lambda i: (v[i] >= k / 2) <> (v[i - 1] >= k / 2)))::DOUBLE AS runs, list_sum(v)::DOUBLE / len(v) AS level FROM v
), w AS (
  SELECT *, 2 * ones * (n - ones) AS p, list_sum(list_transform(v, lambda x: pow(x - level, 2)))::DOUBLE AS sq, coalesce(list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - level) * (v[i + 1] - level))), 0)::DOUBLE AS pairs FROM s
), z AS (
  SELECT *, (cbrt((k / n * squares - n) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1,
         CASE WHEN p * (p - n) > 0 THEN (runs - p / n - 1) / sqrt(p * (p - n) / (n * n * (n - 1))) ELSE {OFF} END AS z2,
         CASE WHEN sq > 0 THEN (pairs / sq + 1 / n) * sqrt(n) ELSE {OFF} END AS z3 FROM w
), c AS (
  SELECT *, CAST(floor(sqrt(pow(greatest(z1, 0), 2) + pow(z2, 2) + pow(z3, 2)) / {BIN}) AS INT) AS bin, NOT regexp_matches(hit, '[0-9]') AS decoy,
         CASE {" ".join(f"WHEN stop - start >= {least} THEN {least}" for least in reversed(CLASSES))} END AS class FROM z
), tops AS (
  SELECT class, bin, (1 + (SELECT count(*) FROM c y WHERE y.class = x.class AND y.decoy AND y.bin <= x.bin)) / (1.0::DOUBLE + (SELECT count(*) FROM c y WHERE y.class = x.class AND y.decoy)) * (SELECT count(*) FROM c y WHERE y.class = x.class AND NOT y.decoy) AS expected,
         {FALSE_SHARE} * (SELECT count(*) FROM c y WHERE y.class = x.class AND NOT y.decoy AND y.bin <= x.bin) AS allowed
  FROM (SELECT DISTINCT class, bin FROM c WHERE NOT decoy AND (bin + 1) * {BIN} <= {RANDOM_LIMIT + BIN}) x
), lim AS (
  SELECT class, max(bin) AS top FROM tops WHERE expected <= allowed GROUP BY class
), r AS (
  SELECT doc_id, kind, start, stop FROM c JOIN lim USING (class) WHERE NOT decoy AND bin <= top
), every AS (
  SELECT doc_id, kind, start, stop, list_position(['assign', 'access', 'hex', 'random'], kind) AS o FROM (SELECT doc_id, kind, start, stop FROM b UNION ALL SELECT * FROM r)
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'random') AS n_random,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> 'random'), '') AS base, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o), '') AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN g USING (doc_id)
"""
