"""Digests of trees of files, each hashed as a stream in order of path: no group's files are held together.

Defined cases: null contents count as empty; paths that repeat follow by content. Groups without files have no row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.folds import sorted_fold


def _hashed(files: DataFrame, group: str, body: str, fed) -> DataFrame:
    kind = dict(files.dtypes)[group]
    rows = files.select(group, F.col("path").alias("path"), F.split("path", "/").alias("__parts"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("__body"))

    def row(state, record):
        fed(state, record["path"].encode(), bytes(record["__body"]))
        return state, None

    return sorted_fold(rows, [group], ["__parts", "__body"], f"`{group}` {kind}, digest string", begin=lambda record: hashlib.sha256(), row=row, end=lambda record, state: (record[group], state.hexdigest()))


def tree_digests(files: DataFrame, group: str) -> DataFrame:
    """group and digest over length, path, length and bytes of each file, lengths as eight bytes. files: group, path, content."""

    def fed(state, path: bytes, body: bytes) -> None:
        for part in (path, body):
            state.update(len(part).to_bytes(8, "big"))
            state.update(part)

    return _hashed(files, group, "content", fed)


def package_digests(files: DataFrame, group: str) -> DataFrame:
    """group and digest over path, NUL, the content's SHA-256 and a line feed of each file; only digests are moved."""

    def fed(state, path: bytes, body: bytes) -> None:
        state.update(b"%b\0%b\n" % (path, body))

    return _hashed(files.select(group, "path", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("__sha")), group, "__sha", fed)
