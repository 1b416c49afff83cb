"""SQL of matches with their places, for the queries that SQL can express."""

from __future__ import annotations


def matches(rows: str, columns: str, text: str, pattern: str, kind: str) -> str:
    """A SELECT of columns, kind, start, stop and hit for each match of a pattern in a table's text.

    What lies between matches and the matches themselves alternate; running sums of their lengths give the places.
    """
    return f"""
  SELECT {columns}, '{kind}' AS kind, CAST(list_sum(list_transform(gaps[:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:k - 1], lambda h: length(h))), 0) AS BIGINT) AS start,
         CAST(list_sum(list_transform(gaps[:k], lambda g: length(g))) + list_sum(list_transform(hits[:k], lambda h: length(h))) AS BIGINT) AS stop, hits[k] AS hit
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT {columns}, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS hits FROM {rows}))"""
