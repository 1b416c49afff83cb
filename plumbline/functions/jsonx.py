"""JSON and map expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = "map<string,string>"


def write_fields(fields: Column, allowed: tuple[str, ...]) -> Column:
    """A map's allowed keys with text, trimmed, as JSON in order of key."""
    kept = F.map_filter(F.transform_values(fields, lambda _, v: F.trim(v)), lambda k, v: k.isin(*allowed) & (v != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def read_fields(text: Column, allowed: tuple[str, ...]) -> Column:
    """A JSON object's allowed keys with text, trimmed; an empty map for what is no such object."""
    parsed = F.coalesce(F.from_json(text, STRINGS), F.from_json(F.lit("{}"), STRINGS))
    return F.map_filter(F.transform_values(parsed, lambda _, v: F.trim(v)), lambda k, v: k.isin(*allowed) & v.isNotNull() & (v != ""))


def merge_keeping(old: Column, new: Column) -> Column:
    """Both maps; of keys that both hold, the old value."""
    return F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)))


@F.pandas_udf(T.BooleanType())
def has_sensitive_key(texts: pd.Series) -> pd.Series:
    """Whether any key of a JSON value, at any depth, names a secret; or any string exceeds 8192 characters."""
    import re

    secret = re.compile(r"(?i)(password|passwd|secret|token|cookie|authorization|api[_-]?key|credential|session)")

    def walk(value) -> bool:
        if isinstance(value, dict):
            return any(secret.search(k) or walk(v) for k, v in value.items())
        if isinstance(value, list):
            return any(map(walk, value))
        return isinstance(value, str) and len(value) > 8192

    def test(text) -> bool | None:
        try:
            return None if text is None else bool(walk(json.loads(text)))
        except ValueError:
            return None

    return texts.map(test)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canvas_references(texts: pd.Series) -> pd.Series:
    """The strings under `file` and the targets of links and embeds under `text` of a nested JSON canvas, in order."""
    import re

    link = re.compile(r"!?\[\[([^\]|#]+)[^\]]*\]\]|!?\[[^\]]*\]\(([^)\s]+)\)")

    def walk(value, out):
        if isinstance(value, dict):
            for key, item in value.items():
                if key == "file" and isinstance(item, str):
                    out.append(item)
                elif key == "text" and isinstance(item, str):
                    out += [a or b for a, b in link.findall(item)]
                else:
                    walk(item, out)
        elif isinstance(value, list):
            for item in value:
                walk(item, out)
        return out

    def read(text):
        try:
            return walk(json.loads(text), [])
        except (TypeError, ValueError):
            return []

    return texts.map(read)
