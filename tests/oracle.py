"""Holds registered queries against their SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def compare(spark, name, build, sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    want = db.sql(sql)
    got = build(spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns), (name, got.columns, want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (name, x, y)
    return len(a)
