"""Deterministic ids and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined_id(*parts: Column, separator: str = "\n", length: int = 20) -> Column:
    """The first hex digits of the SHA-256 of the parts, squeezed and lower-cased, one a line."""
    plain = [F.lower(F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"(?U)\s+", " "))) for p in parts]
    return F.substring(F.sha2(F.concat_ws(separator, *plain), 256), 1, length)


def short_hash(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts as they are, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16)


def task_id(backend: Column, *parts: Column) -> Column:
    return F.concat(backend, F.lit(":"), F.substring(F.sha2(F.concat_ws("\0", backend, *parts), 256), 1, 16))


def set_digest(ids: Column) -> Column:
    """Sorted distinct ids joined by commas; `none` for no ids."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(ids)), ","), F.lit("")), F.lit("none"))


def fill_template(payload: Column, query: Column, mark: str = "{query}") -> Column:
    """A JSON payload with a mark replaced in every string."""
    quoted = F.to_json(F.struct(query.alias("q")))
    return F.replace(payload, F.lit(mark), F.substring(quoted, F.lit(7), F.length(quoted) - 8))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces and no escapes for letters; null for what is no JSON."""

    def plain(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(plain)


def json_digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)
