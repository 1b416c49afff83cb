"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary, taken from a bounded sample of labelled rows. A text is
lower-cased, cut into chunks and each chunk is compressed with every dictionary; sizes are summed over all chunks, so
long texts are judged whole. A prediction is rejected where the best size is not smaller than the second by a margin.

Bounds of the sample, the only part fitted on less than all rows: sample_rows texts a language, those of smallest text
hash, and dictionary_bytes of content a language.

Defined cases: a null text or one without a letter is `und` with score 0, and rejected. Ties go to the language first
in code-point order. Without labelled rows every text is `und`. Null labels and null texts teach nothing; null ids teach,
as they are not held out; copies of a text teach once. Empty tables give empty tables; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, table

UNKNOWN = "und"
SAMPLE_ROWS = 48
DICTIONARY_BYTES = 1 << 15
CHUNK_BYTES = 1 << 11
LEVEL = 9
#: Parts of a language that are ranked on their own first.
PARTS = 64

#: Least share by which the best size must be below the second.
MARGIN = 0.005

NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 after division by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def letters(text: str) -> str:
    """What is compressed: lower-cased letters, all else one space."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionary content of each language, from the rows given; at most sample_rows texts a language reach the driver.

    Ranks are taken in PARTS parts of each language first, so that a frequent language is no hot group: what is ranked as
    one are sample_rows rows of each part. Only hashes are ranked; the texts that they stand for are fetched afterwards.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    hashed = known.select("lang", F.xxhash64("text").alias("h")).groupBy("lang", "h").agg(F.lit(1).alias("one"))
    part = F.pmod("h", F.lit(PARTS))
    in_part = hashed.withColumn("r", F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))).where(F.col("r") <= sample_rows)
    ranked = in_part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_rows)
    chosen = {(r.lang, r.h) for r in ranked.select("lang", "h").collect()}
    if not chosen:
        return {}
    rows = known.withColumn("h", F.xxhash64("text")).where(F.col("h").isin(sorted({h for _, h in chosen})))
    taught: dict[str, list[bytes]] = {}
    for r in rows.select("lang", "h", "text").dropDuplicates(["lang", "h"]).orderBy("lang", "h").toLocalIterator():
        if (r.lang, r.h) in chosen:
            taught.setdefault(r.lang, []).append(letters(r.text).encode() + b" ")
    return {lang: filled(texts, dictionary_bytes) for lang, texts in taught.items()}


def filled(texts: list[bytes], room: int) -> bytes:
    """All texts where there is room; else equal shares, what short texts leave going to longer ones, cut from all over them."""
    share = {}
    for n, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        share[k] = min(len(texts[k]), (room - sum(share.values())) // (len(texts) - n))
    return b"".join(t if share[k] == len(t) else spread(t, share[k]) for k, t in enumerate(texts))


def spread(text: bytes, size: int, pieces: int = 4) -> bytes:
    """size bytes of a text in pieces from its start to its end."""
    each = size // pieces
    gap = (len(text) - each) // (pieces - 1)
    return b"".join(text[k * gap : k * gap + each] for k in range(pieces))


class Classifier:
    """One compressor a language."""

    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.compress = []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and the share by which its size is below the second's."""
        kept = letters(text or "")
        if not self.names or not any(map(str.isalpha, kept)):
            return UNKNOWN, 0.0
        kept = kept.encode()
        sizes = [0] * len(self.names)
        for at in range(0, len(kept), CHUNK_BYTES):
            chunk = kept[at : at + CHUNK_BYTES]
            for k, compress in enumerate(self.compress):
                sizes[k] += len(compress(chunk))
        best, second, *_ = sorted(zip(sizes, self.names, strict=True)) + [(sizes[0], "")] * (len(sizes) < 2)
        return best[1], 1.0 if len(sizes) < 2 else (second[0] - best[0]) / second[0]


def identify(docs: DataFrame, content: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """row_id, lang_pred, score and rejected of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(content).classify
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            said = [pa.array([name for name, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([name == UNKNOWN or s < margin for name, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *said], names=["row_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, content: dict[str, bytes], *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows that identify() does not reject, with the input's columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(content).classify
        for batch in batches:
            found = map(judge, batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != UNKNOWN and s >= margin for name, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the language of every document, learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    content = learn(docs.where(~held_out()))
    judged = identify(docs, content)
    return judged.select(F.col("row_id").alias("doc_id"), held_out("row_id").alias("held_out"), "lang_pred", F.col("score").alias("score"), "rejected")
