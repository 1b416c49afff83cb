"""Streaming folds and two-level scans against plain loops, with one hot key, ties, nulls and many ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import folds, intervals, scan
from plumbline.operators import timeseries as S


def made(n=900, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i if i % 50 else i - 1, rng.choice([None, 1.5, -2.0, 7.25, 0.0]), i) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), "k string, at long, v double, id long").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums_and_extremes(spark, table):
    order = ["at", "id"]
    for parts in (1, 13):
        dealt = scan.ranged(table, ["k"], order, parts)
        assert dealt.select(scan.PART).distinct().count() <= parts
        got = {r.id: (r.n, r.total, r.top) for r in scan.running(dealt, ["k"], order, sums={"n": F.lit(1), "total": "v"}, most={"top": "v"}).collect()}
        assert len(got) == 900
        for rows in by_key(made()).values():
            n = 0
            seen = []
            for _, _, v, i in rows:
                n += 1
                seen += [v] if v is not None else []
                assert got[i] == (n, sum(seen) if seen else None, max(seen, default=None))


def test_previous_and_numbers(spark, table):
    order = ["at", "id"]
    got = {r.id: r.before for r in scan.previous(scan.ranged(table, ["k"], order, 9), ["k"], order, {"before": "id"}).collect()}
    for rows in by_key(made()).values():
        assert [got[r[3]] for r in rows] == [None, *[r[3] for r in rows[:-1]]]
    places = {r.id: r.n for r in scan.numbered(table, order, parts=6).collect()}
    assert [places[r[3]] for r in sorted(made(), key=lambda r: (r[1], r[3]))] == list(range(1, 901))
    own = {r.id: r.n for r in scan.numbered(table, order, keys=["k"], parts=6).collect()}
    for rows in by_key(made()).values():
        assert [own[r[3]] for r in rows] == list(range(1, len(rows) + 1))
    empty = table.limit(0)
    assert scan.numbered(empty, order).count() == scan.previous(scan.ranged(empty, ["k"], order), ["k"], order, {"b": "id"}).count() == 0


def test_trailing_sums_and_peaks(spark, table):
    got = {r.id: r.s for r in scan.trailing(table, "k", "at", 25, {"s": "id"}).collect()}
    assert len(got) == 900
    rows = made()
    for k, at, _, i in rows:
        assert got[i] == sum(j for q, t, _, j in rows if q == k and at - 25 <= t <= at)
    rng = random.Random(6)
    spans = [(k, float(a), float(a + rng.choice([0, 1, 5, 90]))) for k, a, _, _ in rows if k]
    want = {}
    for k in {k for k, *_ in spans}:
        now = best = 0
        for _, d in sorted([(a, 1) for q, a, _ in spans if q == k] + [(b, -1) for q, _, b in spans if q == k]):
            now += d
            best = max(best, now)
        want[k] = best
    data = spark.createDataFrame(spans, "k string, start double, end double")
    assert {r.k: r.peak for r in intervals.peak(data, "k").collect()} == want


def test_fold_carries_state_over_batches(spark, table):
    """A digest of a key's rows in order tells that none is lost, repeated or out of order; batches hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        fold = folds.sorted_fold(table, ["k"], ["at", "id"], "k string, n long, sha string", begin=lambda r: (0, hashlib.sha256()), row=lambda s, r: ((s[0] + 1, s[1].update(f"{r['at']}:{r['id']};".encode()) or s[1]), None), end=lambda r, s: (r["k"], s[0], s[1].hexdigest()))
        want = {k: (len(rows), hashlib.sha256("".join(f"{a}:{i};" for _, a, _, i in rows).encode()).hexdigest()) for k, rows in by_key(made()).items()}
        assert {r.k: (r.n, r.sha) for r in fold.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.sorted_fold(table.limit(0), ["k"], ["at"], "k string", begin=lambda r: 0, row=lambda s, r: (s, (r["k"],))).count() == 0


def test_a_long_series_folds_in_bounded_memory(spark):
    """One key of a million rows; the fold of RSI over a saw tooth repeats with it."""
    rows = spark.range(1_000_000).select(F.lit("s").alias("series_id"), F.col("id").alias("ord"), (F.col("id") % 10).cast("double").alias("close"))
    out = S.rsi(rows, "close", 6)
    last = out.where("ord >= 999980").orderBy("ord").collect()
    assert len(last) == 20 and all(abs(a.RSI6 - b.RSI6) < 1e-9 for a, b in zip(last[:10], last[10:], strict=True)) and out.count() == 1_000_000
