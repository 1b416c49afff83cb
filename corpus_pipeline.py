"""The corpus pipeline: language ID, near-dedup, sanitising, mixing, tokens.

Each stage takes all rows that its predecessor left and returns the columns of documents; the last one returns the token
ids of every row of the mix, and the text that these ids decode to. A document that the mix takes more than once has as
many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, language, minhash, mixing, pii
from plumbline.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rows whose language is not told go. Learnt from the rows given that are not held out."""
    return language.drop_rejected(docs, language.learn(docs.where(~language.held_out())))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the document of smallest id of each group stays."""
    return minhash.drop_near_duplicates(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data, and terms that give it away, are replaced by their kind."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each row as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, n_tokens, ids and the decoded text of each row."""
    coded = bpe.encode_decode(docs)
    ids = F.col("ids")
    return coded.select(F.col("row_id").alias("doc_id"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids, F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", remove_near_duplicates),
    ("personal data removal", remove_personal_data),
    ("source mixing", mix_sources),
    ("token encoding", encode),
]

#: Compression, hashing and merges have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{n}")
            if n:
                scratch.drop(f"stage-{n - 1}")
    return docs
