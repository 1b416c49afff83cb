"""Substring dedup by hashing units of lines: of each repeated passage the earliest place stays, the others go.

A unit is a line, cut further after its end marks (. ! ?), as whole lines find only 819 of the 1,350 repeated passages of 50
words or more in the sf0.1 documents, and single short lines repeat by chance in half of the documents. Units are normalised
(A-Z lower-cased, white space squeezed) and their digests grouped over all rows; the row of smallest id holds the earliest
place. A unit is a repeat if an earlier row, or an earlier place of its own row, holds the same digest. Runs of repeats
without a gap are passages; those of least_words words or more are removed (1 removes each repeated unit).

Counts are partial sums, each digest once a row, so that a passage in very many rows is no hot group.

Defined cases: null texts and texts without words have no units. Null ids rank last, and after one another not at all. Rows
of equal rank keep what only they share. Rows that repeat id and text are one row. Empty tables give empty tables; other
columns are ignored, or passed on by drop_repeats(). Offsets are code points of the original text, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bounded_batches, free_names, row_key, table
from plumbline.llm.spans import redacted

UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
LEAST_WORDS = 20
LAST = 2**63 - 1

UNITS = "row_key binary, rank long, at int, start int, end int, words int, digest long, again boolean"


def units_of(text: str | None) -> list[tuple[int, int, int, int]]:
    """start, end, number of words and digest of each unit with a word."""
    out = []
    for found in UNIT.finditer(text or ""):
        words = found[0].encode().lower().split()
        if words:
            out.append((found.start(), found.end(), len(words), xxhash.xxh3_64_intdigest(b" ".join(words))))
    return out


def document_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit: the row's key and rank, the unit's number and place, words, digest and whether its row holds it before."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks, rows = [], [], []
            for key, rank, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen: set[int] = set()
                for at, unit in enumerate(units_of(text)):
                    rows.append((at, *unit, unit[3] in seen))
                    seen.add(unit[3])
                keys += [key] * (len(rows) - len(keys))
                ranks += [rank] * (len(rows) - len(ranks))
                if len(rows) > 50_000:
                    yield _batch(keys, ranks, rows)
                    keys, ranks, rows = [], [], []
            yield _batch(keys, ranks, rows)

    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rank"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, UNITS)


def _batch(keys: list, ranks: list, rows: list) -> pa.RecordBatch:
    at, start, end, words, digest, again = zip(*rows, strict=True) if rows else [()] * 6
    small = [pa.array(x, pa.int32()) for x in (at, start, end, words)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ranks, pa.int64()), *small, pa.array(np.array(digest, "u8").view("i8")), pa.array(again, pa.bool_())], names=["row_key", "rank", "at", "start", "end", "words", "digest", "again"])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """row_key, rank and passages: number of words, place and the earliest row's rank of each passage to remove, by start."""
    scratch = Scratch(docs.sparkSession, "passages")
    units = scratch.keep(document_units(docs, id_col=id_col, text_col=text_col), "units")
    first = units.where("not again").groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("digest", "first")
    # Written and read again, so that both sides of the join are shuffles that adaptive execution may split at a hot digest.
    first = scratch.keep(first, "first")
    found = units.join(first, "digest", "left").where("again or rank > first")
    unit = F.struct("at", "start", "end", "words", F.coalesce("first", "rank").alias("first"))
    rows = found.groupBy("row_key", "rank").agg(F.sort_array(F.collect_set(unit)).alias("units"))

    start = F.struct(F.lit(-2).alias("at"), F.array().cast("array<struct<words:int,start:int,end:int,first:bigint>>").alias("runs"))

    def step(acc: Column, u: Column) -> Column:
        last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
        longer = F.struct((last["words"] + u["words"]).alias("words"), last["start"].alias("start"), u["end"].alias("end"), F.least(last["first"], u["first"]).alias("first"))
        new = F.struct(u["words"].alias("words"), u["start"].alias("start"), u["end"].alias("end"), u["first"].alias("first"))
        before = F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1)
        runs = F.when(u["at"] == acc["at"] + 1, F.array_append(before, longer)).otherwise(F.array_append(acc["runs"], new))
        return F.struct(u["at"].alias("at"), runs.alias("runs"))

    runs = F.aggregate("units", start, step, lambda acc: acc["runs"])
    return rows.select("row_key", "rank", F.filter(runs, lambda r: r["words"] >= least_words).alias("passages")).where(F.size("passages") > 0)


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The input's rows and columns, texts without repeated passages."""
    cuts = repeats(docs, id_col=id_col, text_col=text_col, least_words=least_words)
    key, spans_of = free_names(docs, "row_key", "spans")
    spans = cuts.select(F.col("row_key").alias(key), F.transform("passages", lambda p: F.struct(p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end"), F.lit("").alias("put"))).alias(spans_of))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left")
    text = F.when(F.col(spans_of).isNotNull(), redacted(F.col(text_col), F.col(spans_of))).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every passage to remove: the document, the place, its words and the earliest document that holds some of it."""
    found = repeats(table(spark, sf_dir, "documents")).select("rank", F.explode("passages").alias("p"))
    return found.select(F.nullif(F.col("rank"), F.lit(LAST)).alias("doc_id"), F.col("p.start").cast("long").alias("start_char"), F.col("p.end").cast("long").alias("end_char"), F.col("p.words").cast("long").alias("n_words"), F.nullif(F.col("p.first"), F.lit(LAST)).alias("first_doc_id"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT doc_id, generate_subscripts(units, 1) AS place, unnest(units) AS unit
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS units FROM documents WHERE text IS NOT NULL)
), o AS (
  SELECT *, CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char,
         regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM u
), w AS (
  SELECT doc_id, start_char, start_char + length(unit) AS end_char, len(words) AS n, array_to_string(words, ' ') AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM o WHERE len(words) > 0
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS first_doc, row_number() OVER (PARTITION BY doc_id, norm ORDER BY k) > 1 AS again FROM w
), r AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f WHERE again OR doc_id > first_doc
)
SELECT doc_id, min(start_char) AS start_char, max(end_char) AS end_char, CAST(sum(n) AS BIGINT) AS n_words, min(first_doc) AS first_doc_id
FROM r GROUP BY doc_id, run HAVING sum(n) >= 20
"""
