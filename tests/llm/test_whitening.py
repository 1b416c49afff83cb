import math

import numpy as np
import pytest

from plumbline.llm import whitening as M


def brute(rows, k):
    """By id: n, deviation, whitened (signs as the operator sets them), explained."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in rows)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    kept = values > 1e-10 * values[0]
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)
    own = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in xs]
    white = (np.array(own, float) / n) @ vectors / np.sqrt(values)
    return n, [(i, sum(a * a for a in o), w) for (i, _), o, w in zip(rows, own, white, strict=True)], values / (c * c).sum() * n


def hold(spark, rows, k=16):
    data = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, x string")
    got = M.whiten(data, components=k).collect()
    n, want, explained = brute(rows, k)
    assert len(got) == len(want) * len(explained) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    for c, share in enumerate(explained):
        own = [r for r in got if r.component == c + 1]
        assert abs(own[0].explained - share) < 1e-9
        key = lambda r: (r[0] is not None, r[0], r[1], round(r[2], 5))
        a, b = sorted(((r.row_id, int(r.deviation), r.whitened) for r in own), key=key), sorted(((i, d, float(w[c])) for i, d, w in want), key=key)
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.abs(np.array([x[2] for x in a]) - np.array([x[2] for x in b])).max() < 1e-6


def test_matches_eigh_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist()), (5, base[6].tolist()), (900 + 1, None), (902, [1.0, None]), (903, [math.nan] * 20), (904, [math.inf] * 20), (905, [0.5, -0.5]), (906, [])]
    hold(spark, rows)


def test_low_rank_and_hot_vector(spark):
    rng = np.random.default_rng(2)
    spread = rng.integers(-9, 9, (60, 3)).astype(float)
    rows = [(i, [a, b, c, a + b, a, 0.0]) for i, (a, b, c) in enumerate(spread.tolist())] + [(1000 + i, [1.0, 2.0, 3.0, 3.0, 1.0, 0.0]) for i in range(200)]
    hold(spark, rows)


def test_tables_without_components(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, []), (2, [])]):
        assert M.whiten(spark.createDataFrame(rows, schema)).count() == 0


def test_large_numbers_stay_exact():
    x, n = np.array([[2**52, 5], [-(2**52), 7]], "i8"), 10**9
    sums = [3 * 10**20, 11]
    assert M.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


class Given:
    """A fit list with a known covariance."""

    def __init__(self, matrix):
        self.matrix, self.dim, self.passes = matrix, len(matrix), 0

    def times(self, block):
        self.passes += 1
        return self.matrix @ block


@pytest.mark.parametrize("spectrum", [np.r_[np.full(30, 5.0), np.full(70, 1.0)], 0.5 ** np.arange(100), np.r_[10.0, np.zeros(99)], np.linspace(2, 1, 100)])
def test_lanczos_finds_repeated_and_hidden_values(spectrum):
    rng = np.random.default_rng(3)
    axes, _ = np.linalg.qr(rng.standard_normal((100, 100)))
    fit = Given((axes * spectrum) @ axes.T)
    values, vectors = M.principal(fit, 16)
    want = np.sort(spectrum)[::-1][:16]
    want = want[want > M.ZERO * want[0]]
    assert len(values) >= len(want) and np.abs(values[: len(want)] - want).max() < 1e-11 * want[0]
    assert np.abs(fit.matrix @ vectors - vectors * values).max() < 1e-9 and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert fit.passes <= 9


def test_query_matches_eigh(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    n, want, explained = brute(rows, 16)
    got = M.query(spark, at).collect()
    assert len(got) == 16 * len(rows) and dict(M.query(spark, at).dtypes)["deviation"] == "bigint"
    by = {(r.vec_id, r.component): r for r in got}
    for i, d, w in want:
        for c in range(16):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.whitened - w[c]) < 1e-6 and abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
