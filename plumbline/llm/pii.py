"""Personal data, and terms that give it away, in DataFrame functions only.

Four patterns find the base spans; what they match are the protected entities. Information theory finds the rest: the
share of an entity's information content that a term reveals is PMI(term, entity) / IC(entity). All three counts are of
documents of the whole corpus: those that hold the term, the entity, and both, however far apart these stand. A term that
shares SUPPORT documents or more with an entity and reveals DISCLOSURE of it or more is a span wherever a document that
holds the entity has it, outside of base spans; sanitise() generalises it like the entity itself.

Counts are partial sums, so that a frequent term or entity is no hot group.

Defined cases: a null text counts as empty. Each row is a document. Rows that repeat id and text have the same spans.
Null ids are kept. Empty tables give empty tables; other columns are ignored, or passed on by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, row_key, table
from plumbline.llm.spans import listed, matches, redacted
from plumbline.llm.sqltext import matches as sql_matches

#: Fixed by the contract of op4, with possessive repeats where no other match can follow, and starts only where a run of
#: the first class starts (or the last match ended), so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PLACES = "array<struct<start:bigint,end:bigint>>"

TERM = r"\p{L}++"
SUPPORT = 2
DISCLOSURE = 0.8


def _valid_ip(hit: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; matches that fail their kind's rule are dropped."""
    digits = lambda hit: F.regexp_replace(hit, "[^0-9]", "")
    card = lambda s: F.length(digits(s["hit"])).between(13, 19) & F.call_function("luhn_check", digits(s["hit"]))
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda s: _valid_ip(s["hit"])),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), card),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["hit"])).between(9, 15)),
    }


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.xxhash64(F.lit(kind), F.lower(s["hit"])))


def _words(text_col: str) -> Column:
    """The hashes of a text's terms, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(TERM), 0), lambda w: F.xxhash64(F.lower(w))))


def _with_spans(rows: DataFrame, text: Column, *columns) -> DataFrame:
    """columns, the spans of each kind, and the hashes of all terms, null for rows without a span."""
    found = rows.select(*columns, text.alias("__text"), *[s.alias(kind) for kind, s in base_spans(text).items()])
    some = F.size(F.concat(*KINDS)) > 0
    return found.withColumn("words", F.when(some, _words("__text"))).withColumn("__text", F.when(some, F.col("__text"))).withColumnRenamed("__text", "text")


def hidden_terms(spans: DataFrame, docs: DataFrame, scratch: Scratch, *, text_col: str, support: int, disclosure: float) -> DataFrame:
    """row_key and hidden: the hashes of each document's terms that reveal too much of an entity it holds, counted by document.

    spans: row_key, the spans of each kind and words, of the rows that hold an entity, so that no other text is moved.
    ln(N / n_term) is never less than the PMI, so terms too frequent for every entity of a document are not paired.
    """
    n = float(docs.count())
    own = spans.groupBy("row_key").agg(F.first(F.array_distinct(F.concat(*map(_entities, KINDS)))).alias("entities"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    own = scratch.keep(own, "own")
    each = own.select("row_key", "copies", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.sum("copies").alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < n))
    held = scratch.keep(each.join(entities, "entity"), "held")
    least = lambda c: F.lit(disclosure) * F.ln(F.lit(n) / F.col(c)) - 1e-9
    top = held.groupBy("row_key").agg(F.max("n_entity").alias("top"))
    counts = docs.select(F.explode(_words(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= support)
    words = own.join(top, "row_key").select("row_key", "top", F.explode("words").alias("term"))
    rare = words.join(counts, "term").where(F.ln(F.lit(n) / F.col("n_term")) >= least("top")).select("row_key", "term", "n_term")
    pairs = scratch.keep(rare.join(held, "row_key").where(F.ln(F.lit(n) / F.col("n_term")) >= least("n_entity")), "pairs")
    both = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).where(F.col("n_both") >= support)
    told = both.where(F.ln(F.lit(n) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.ln(F.lit(n) / F.col("n_entity")) >= disclosure)
    return pairs.join(told.select("entity", "term"), ["entity", "term"], "left_semi").groupBy("row_key").agg(F.collect_set("term").alias("hidden"))


def _places(text: Column, hidden: Column) -> Column:
    """start and end of each term of the text that is hidden."""
    pairs = F.zip_with(F.split(text, TERM, -1), F.regexp_extract_all(text, F.lit(TERM), 0), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["hit"])
        longer = F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(F.array_contains(hidden, F.xxhash64(F.lower(pair["hit"]))), longer).otherwise(acc["spans"])
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), spans.alias("spans")))

    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """row_id, row_key, the spans of each kind (start, end, hit) and terms: the places of revealing terms, by start."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(_with_spans(docs, F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).alias("row_id"), row_key(id_col, text_col).alias("row_key")), "found")
    some = found.where("words is not null")
    hidden = scratch.keep(hidden_terms(some, docs, scratch, text_col=text_col, support=support, disclosure=disclosure), "hidden")
    outside = lambda t: ~F.exists(F.concat(*KINDS), lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    places = F.filter(_places(F.col("text"), F.col("hidden")), outside).alias("terms")
    terms = scratch.keep(some.join(hidden, "row_key").dropDuplicates(["row_key"]).select("row_key", places), "terms")
    scratch.drop_all_but("found", "terms")
    return found.select("row_id", "row_key", *KINDS).join(terms, "row_key", "left").select("row_id", "row_key", *KINDS, F.coalesce("terms", F.array().cast(PLACES)).alias("terms"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The input's rows and columns; in texts each base span is replaced by its kind in brackets, and a revealing term by [term].

    Rows without a span are passed on as they are; only the others are written, and meet their hidden terms in a join.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    touched = scratch.keep(_with_spans(docs, text, row_key(id_col, text_col).alias("row_key"), whole).where("words is not null"), "touched")
    hidden = scratch.keep(hidden_terms(touched, docs, scratch, text_col=text_col, support=support, disclosure=disclosure), "hidden")
    scratch.drop_all_but("touched", "hidden")
    put = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("put")))
    base = F.concat(*[put(k, k) for k in KINDS])
    outside = lambda t: ~F.exists(F.concat(*KINDS), lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    terms = F.when(F.col("hidden").isNotNull(), put("term", F.filter(_places(F.col("text"), F.col("hidden")), outside)))
    every = F.sort_array(F.concat(base, F.coalesce(terms, F.array().cast("array<struct<start:bigint,end:bigint,put:string>>"))))
    cleaned = touched.join(hidden, "row_key", "left").select("whole_row", redacted(F.col("text"), every).alias("text"))
    cleaned = cleaned.select(*[F.col("text").alias(c) if c == text_col else F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns])
    return docs.where(F.size(F.concat(*base_spans(text).values())) == 0).unionByName(cleaned)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: counts, base digest and all spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[listed(k, F.col(k)) for k in KINDS])
    return found.select(
        F.col("row_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term", F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT) ELSE CAST(substr({_DIGITS}, i, 1) AS INT) * 2 - CASE WHEN CAST(substr({_DIGITS}, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT *, 1 AS o FROM ({sql_matches("d", "doc_id, text", "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "email")})
  UNION ALL SELECT *, 2 FROM ({sql_matches("d", "doc_id, text", "text", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "ip")}) WHERE len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 0) > 255)) = 0
  UNION ALL SELECT *, 3 FROM ({sql_matches("d", "doc_id, text", "text", "[0-9](?:[\\x20-]?[0-9])+", "card")}) WHERE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT *, 4 FROM ({sql_matches("d", "doc_id, text", "text", "\\+[0-9][\\x20().0-9-]+[0-9]", "phone")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15
), e AS (
  SELECT DISTINCT doc_id, kind || ':' || lower(hit) AS entity FROM b
), ent AS (
  SELECT entity, count(*) AS n_entity FROM e GROUP BY entity
), words AS (
  SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda w: lower(w)))) AS term FROM d
), terms AS (
  SELECT term, count(*) AS n_term FROM words GROUP BY term HAVING count(*) >= {SUPPORT}
), both_ AS (
  SELECT entity, term, count(*) AS n_both FROM e JOIN words USING (doc_id) GROUP BY ALL HAVING count(*) >= {SUPPORT}
), told AS (
  SELECT entity, term FROM both_ JOIN ent USING (entity) JOIN terms USING (term), (SELECT count(*)::DOUBLE AS n FROM d)
  WHERE n_entity < n AND ln(n * n_both / (n_term * n_entity)) / ln(n / n_entity) >= {DISCLOSURE}
), hid AS (
  SELECT DISTINCT doc_id, term FROM e JOIN told USING (entity)
), cut AS (
  SELECT doc_id, string_split_regex(text, '\p{{L}}+') AS gaps, regexp_extract_all(text, '\p{{L}}+') AS hits FROM d WHERE doc_id IN (SELECT doc_id FROM hid)
), tok AS (
  SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, unnest(list_transform(gaps[:len(hits)], lambda g: length(g))) AS gap, unnest(hits) AS hit FROM cut
), at_ AS (
  SELECT doc_id, lower(hit) AS term, CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop, length(hit) AS size FROM tok
), near AS (
  SELECT doc_id, stop - size AS start, stop FROM at_ SEMI JOIN hid USING (doc_id, term)
), every AS (
  SELECT doc_id, kind, start, stop, o FROM b UNION ALL SELECT doc_id, 'term', start, stop, 5 FROM near n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = n.doc_id AND n.start < b.stop AND b.start < n.stop)
), g AS (
  SELECT doc_id, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone, count(*) FILTER (o = 5) AS n_term,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 5), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN g USING (doc_id)
"""
