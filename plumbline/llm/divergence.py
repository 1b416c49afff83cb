"""Source divergence audit: how the sources of a language differ from it and from each other, in exact whole numbers.

Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in LEAST_DOCS or more of its
documents. A group (language and source) and a language give each kept term the share p = 1 + floor(SCALE * (count + 1) /
(N + V)), with N the counts of all kept terms and V their number. f = floor((p - q)^2 / q) compares p with q.

Part "term" compares a group with its language, term by term, and keeps the TOP terms. Radix selection finds them: from
the highest bits of f down, histograms of DIGIT bits tell for each group the digit that holds the TOP-th value, until one
value is left; ties on it are settled by the first bytes of the terms, 4, 8, 16 and so on at a time. Histograms are partial
sums, so no group is sorted or gathered; only TOP rows a group are ranked.

Part "pair" compares each two groups of a language over all its kept terms, but handles only terms that a group holds. With
f0 the value of a term that neither holds, the sum is V * f0, plus what each term of either group adds alone (by distinct
counts: terms that stand there as often add the same), plus a correction for terms that both hold. Its rows are the pairs
of groups, as the result lists them, and pairs of groups that share a term, summed before they are shuffled.

Defined cases: null texts, languages and sources count as empty. Every row is a document, also repeated ones. Groups without
terms are compared by their even shares. A language without kept terms has pairs of value 0. One source in a language has
no pairs. Empty tables give empty tables; other columns are ignored. Values fit a long up to 10^9 kept terms a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, lower_ascii, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between terms: cutting there takes a fifth of the time of extracting each match.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Bits of a value that one histogram tells apart.
DIGIT = 16
#: Parts into which the rows of a group are dealt where they meet the group's own row.
SALTS = 16
#: First bytes of terms that the first histogram of ties tells apart; doubled each time.
PREFIX = 4


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, by way of decimals, as SCALE times a count may exceed a long."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, (total + kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers below 3 * 10^9."""
    return F.call_function("div", (p - q) * (p - q), q)


def occurrences(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (places) and docs (documents) of every term, kept or not. Each text's terms follow once with
    repeats and once without."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN), "")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), words.alias("words"))
    each = rows.select("lang", "source", F.size("words").alias("size"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("at", "term"))
    again = F.col("at") >= F.col("size")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.when(again, 0).otherwise(1)).alias("n"), F.sum(F.when(again, 1).otherwise(0)).alias("docs"))


class Audit:
    """Shares of all kept terms that groups hold, and the groups' own numbers, as tables of the shared folder.

    groups: lang, source, base (share of a term that the group lacks), kept (V). rated: lang, source, term, p, base, q.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, *, text_col: str, lang_col: str, source_col: str, least_docs: int):
        names = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
        counts = scratch.keep(occurrences(docs, text_col, lang_col, source_col), "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= least_docs).drop("docs")
        held = scratch.keep(counts.drop("docs").join(kept, ["lang", "term"]), "held")
        scratch.drop("counts")
        langs = held.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.sum("in_lang").alias("of_lang"), F.count(F.lit(1)).alias("kept"))
        own = held.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
        groups = docs.select(*names).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["of_group", "of_lang", "kept"])
        base = F.when(F.col("kept") > 0, share(F.lit(0), F.col("of_group"), F.col("kept"))).otherwise(1)
        self.groups = scratch.keep(groups.withColumn("base", base), "groups")
        salted = self.groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = held.withColumn("salt", _salt()).join(salted, ["lang", "source", "salt"])
        p, q = share(F.col("n"), F.col("of_group"), F.col("kept")), share(F.col("in_lang"), F.col("of_lang"), F.col("kept"))
        self.rated = scratch.keep(rows.select("lang", "source", "term", p.alias("p"), "base", q.alias("q")), "rated")
        scratch.drop("held")


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")


def _settled(rows: DataFrame, digit: Column, downward: bool) -> DataFrame:
    """One histogram: rows (lang, source, term, value, left) that are surely among the first left of their group, with left
    0, and those of the digit that holds the left-th, with what is left for it."""
    rows = rows.withColumn("digit", digit)
    order = F.desc("digit") if downward else F.asc("digit")
    up_to = Window.partitionBy("lang", "source").orderBy(order)
    bars = rows.groupBy("lang", "source", "left", "digit").agg(F.count(F.lit(1)).alias("found")).withColumn("reach", F.sum("found").over(up_to))
    cut = bars.where((F.col("reach") >= F.col("left")) & (F.col("reach") - F.col("found") < F.col("left")))
    rest = F.when(F.col("reach") == F.col("left"), 0).otherwise(F.col("left") - F.col("reach") + F.col("found"))
    at = cut.select("lang", "source", F.col("digit").alias("cut"), rest.alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", _salt()).join(at, ["lang", "source", "salt"], "left")
    before = F.col("digit") > F.col("cut") if downward else F.col("digit") < F.col("cut")
    inside = F.col("cut").isNull() | before
    return met.where(inside | (F.col("digit") == F.col("cut"))).select("lang", "source", "term", "value", F.when(inside, 0).otherwise(F.col("rest")).cast("long").alias("left"))


def first_values(rows: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """lang, source, term and value of the top rows of each group, by value downward, then by the terms' bytes."""
    now = rows.select("lang", "source", "term", "value", F.lit(top).cast("long").alias("left"))
    chosen, turn = [], 0

    def settle(digit: Column, downward: bool) -> None:
        nonlocal now, turn
        done = scratch.keep(_settled(now, digit, downward), f"turn-{turn}")
        chosen.append(done.where("left = 0").drop("left"))
        now, turn = done.where("left > 0"), turn + 1

    for shift in range(64 - DIGIT, -1, -DIGIT):
        settle(F.shiftright("value", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)), True)
    width = PREFIX
    while not now.isEmpty():
        settle(F.substring(F.encode("term", "UTF-8"), 1, width), False)
        width *= 2
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def term_part(audit: Audit, top: int, scratch: Scratch) -> DataFrame:
    over = audit.rated.where("p > q").select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
    return first_values(over, top, scratch).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")


def pair_part(audit: Audit) -> DataFrame:
    """Each two groups of a language: V * f0, what terms of either add alone, and the correction for terms of both."""
    g = audit.groups.select("lang", "source", F.col("base").alias("g0"), "kept")
    h = audit.groups.select("lang", F.col("source").alias("item"), F.col("base").alias("h0"))
    pairs = g.join(h, "lang").where("source != item")
    neither = gap(F.col("g0"), F.col("h0"))
    bars = audit.rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    of_g = pairs.join(bars.withColumnRenamed("p", "p_g"), ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (gap(F.col("p_g"), F.col("h0")) - neither)).alias("value"))
    of_h = pairs.join(bars.select("lang", F.col("source").alias("item"), F.col("p").alias("p_h"), "terms"), ["lang", "item"]).select("lang", "source", "item", (F.col("terms") * (gap(F.col("g0"), F.col("p_h")) - neither)).alias("value"))
    left = audit.rated.select("lang", "term", "source", F.col("p").alias("p_g"), F.col("base").alias("g0"))
    right = audit.rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_h"), F.col("base").alias("h0"))
    both = gap(F.col("p_g"), F.col("p_h")) - gap(F.col("p_g"), F.col("h0")) - gap(F.col("g0"), F.col("p_h")) + neither
    shared = left.join(right, ["lang", "term"]).where("source != item").groupBy("lang", "source", "item").agg(F.sum(both).alias("value"))
    even = pairs.select("lang", "source", "item", (F.col("kept") * neither).alias("value"))
    total = even.unionByName(of_g).unionByName(of_h).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def audit_sources(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: the other sources by divergence, and the top terms that mark the group."""
    scratch = Scratch(docs.sparkSession, "divergence")
    audit = Audit(docs, scratch, text_col=text_col, lang_col=lang_col, source_col=source_col, least_docs=least_docs)
    rows = pair_part(audit).unionByName(term_part(audit, top, scratch))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by_value))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: divergence of every source of every language."""
    return audit_sources(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS words FROM documents
), w AS (
  SELECT doc, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT dense.lang, source, term, dense.n, CAST(1 + {SCALE}::HUGEINT * (dense.n + 1) // (sum(dense.n) OVER (PARTITION BY dense.lang, source) + v) AS BIGINT) AS p, CAST(1 + {SCALE}::HUGEINT * (in_lang + 1) // (v.n + v) AS BIGINT) AS q
  FROM dense JOIN v ON v.lang = dense.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
