"""Sorted streaming folds: what needs a key's rows one after the other, in bounded memory.

Rows are dealt by key and sorted within partitions, both by Spark, which spills; a task then passes over its keys in Arrow
batches and carries a key's state from batch to batch. No key is ever held as one list or frame, so its length is bounded
by time alone.

Defined cases: keys and orders may be null (nulls first). Rows that tie in the order come in no certain order: name enough
columns. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of an output batch.
ROWS = 4096

Row = dict[str, Any]


def sorted_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str | StructType, *, begin: Callable[[Row], Any], row: Callable[[Any, Row], tuple[Any, tuple | list[tuple] | None]], end: Callable[[Row, Any], tuple | list[tuple] | None] | None = None) -> DataFrame:
    """Folds the rows of each key in order. begin(first row) gives a key's state; row(state, record) the next state and an
    output row, several in a list, or None; end(last record, state) last ones."""
    names, width = rows.columns, [rows.columns.index(k) for k in keys]
    out_schema = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in out_schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    def listed(told: tuple | list[tuple] | None) -> list[tuple]:
        return told if isinstance(told, list) else [] if told is None else [told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = last = None
        out: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                record = dict(zip(names, values, strict=True))
                own = tuple(values[i] for i in width)
                if own != key or last is None:
                    if last is not None and end:
                        out += listed(end(last, state))
                    key, state = own, begin(record)
                state, told = row(state, record)
                last = record
                out += listed(told)
                if len(out) >= ROWS:
                    yield batch_of(out)
                    out = []
        if last is not None and end:
            out += listed(end(last, state))
        yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def folded_columns(rows: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: str, *, begin: Callable[[Row], Any], row: Callable[[Any, Row], tuple[Any, tuple]]) -> DataFrame:
    """All rows with their columns and further ones, which row(state, record) gives with the next state."""
    names = rows.columns
    schema = StructType([*rows.schema.fields, *_parse_datatype_string(outputs).fields])

    def widened(state: Any, record: Row) -> tuple[Any, tuple]:
        state, told = row(state, record)
        return state, (*(record[n] for n in names), *told)

    return sorted_fold(rows, keys, order, schema, begin=begin, row=widened)
