"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (A-Z lower-cased, white space squeezed) and hashed. For each host the documents that hold a line
are counted; lines on more documents than the host's limit are boilerplate and removed. A document that loses more than
its limit of words that way is depleted and rejected, as is one that fails the base rules.

Documents of a host are counted by partial sums, each line once a document, so a frequent line is no hot group.

Defined cases: a null text has no words and fails. Null sources are one host. Each row is a document: repeated rows
count as often as they stand there, and get equal verdicts. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Scratch, free_names, lower_ascii, row_key, table

#: A line is boilerplate on more documents of a host than MIN_DOCS and than HOST_SHARE of the host's documents,
#: or on more than MOST_DOCS of them.
MIN_DOCS = 20
HOST_SHARE = 0.01

#: Documents of a host beyond which a line is boilerplate however large the host is.
MOST_DOCS = 100

#: A document is depleted once more than this share of its words is boilerplate.
MOST_REMOVED = 0.5

#: Base rules, fixed by the contract of op9.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row even where a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that the list holds twice or more.

    Windows are hashed; only lists with equal hashes are sorted by hash, to find the places of repeated windows. Each
    such place then covers the words from it on that the place before does not.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))

        def places(rows: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(rows, i)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])

        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, at: F.struct((at + 3).alias("end"), (acc["n"] + at + 3 - F.greatest(acc["end"], at)).alias("n"))
        count = F.aggregate(F.sort_array(let(ordered, places)), start, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashed)) < F.size(hashed), count).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) >= 3, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def base_metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row_id, row_key (the same for equal rows only), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        row_key(id_col, source_col, text_col).alias("row_key"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return rows.select(
        "row_id",
        "row_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def squeezed(line: Column) -> Column:
    """A line as it is compared."""
    return F.trim(F.regexp_replace(lower_ascii(line), SPACE, " "))


def document_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row_key, host (hash of the source) and lines: hash and number of words of each normalised line with a word."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), squeezed), lambda line: line != "")
    return docs.select(
        row_key(id_col, source_col, text_col).alias("row_key"),
        F.xxhash64(F.coalesce(F.col(source_col), F.lit("\0"))).alias("host"),
        F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("words"))).alias("lines"),
    )


def boilerplate(lines: DataFrame, *, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """host and line of each line on too many documents of its host: more than min_docs, and more than host_share or most_docs."""
    hosts = lines.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    each = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") > min_docs)
    return counts.join(hosts, "host").where(F.col("found") > F.least(host_share * F.col("docs"), F.lit(float(most_docs)))).select("host", "line")


def without_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """The input's rows and columns, with boilerplate lines taken out of the texts. Texts without such lines stay as they are."""
    cols = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    lines = Scratch(docs.sparkSession, "lines").keep(document_lines(docs, **cols), "lines")
    frequent = boilerplate(lines, min_docs=min_docs, host_share=host_share, most_docs=most_docs)
    places = lines.select("row_key", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    key, taken_of = free_names(docs, "row_key", "taken")
    taken = places.join(frequent, ["host", "line"], "left_semi").groupBy(F.col("row_key").alias(key)).agg(F.collect_set("line").alias(taken_of))
    joined = docs.withColumn(key, row_key(id_col, source_col, text_col)).join(taken, key, "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda line: ~F.array_contains(taken_of, F.xxhash64(squeezed(line))))
    text = F.when(F.col(taken_of).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """row_id, the base metrics, removed (words of boilerplate lines), base_failed, depleted and kept of each row."""
    cols = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    scratch = Scratch(docs.sparkSession, "quality")
    lines = scratch.keep(document_lines(docs, **cols), "lines")
    frequent = boilerplate(lines, min_docs=min_docs, host_share=host_share)
    places = lines.select("row_key", "host", F.explode("lines").alias("it")).select("row_key", "host", "it.*")
    removed = places.join(frequent, ["host", "line"], "left_semi").groupBy("row_key").agg(F.sum("words").alias("removed"))
    rows = lines.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    lost = removed.join(rows, "row_key").select("row_key", (F.col("removed") / F.col("copies")).cast("long").alias("removed"))
    found = base_metrics(docs, **cols).join(lost, "row_key", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("depleted", F.col("removed") > most_removed * F.col("n_words")).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("row_key")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: base metrics and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(F.col("row_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
), held AS (
  SELECT doc_id, host, line, len(w) AS n, array_to_string(w, ' ') AS norm FROM lines WHERE len(w) > 0
), hosts AS (
  SELECT host, count(*) AS docs FROM d GROUP BY host
), frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS found FROM held GROUP BY host, norm) JOIN hosts USING (host) WHERE found > 20 AND found > least(0.01 * docs, 100)
), lost AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS removed FROM held SEMI JOIN frequent USING (host, norm) GROUP BY doc_id
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, words[i:i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_word FROM again) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT removed > 0.5 * n_words AS kept
FROM m
"""
