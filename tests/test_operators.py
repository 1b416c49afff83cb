import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence as E
from plumbline.operators import graph, intervals, joins, ledger, ranking, upserts
from plumbline.operators import timeseries as S


def series(spark, closes, **more):
    rows = [("s", i, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, ord int, close double").withColumns({k: F.lit(v) if not isinstance(v, str) else F.col(v) for k, v in more.items()})


def column(frame, name):
    return [r[name] for r in frame.orderBy("ord").collect()]


def test_rolling_mean(spark):
    assert column(S.rolling_mean(series(spark, [1, 2, 3, 4, 5, 6]), "close", 5), "MA5") == [None] * 4 + [3.0, 4.0]


@pytest.mark.parametrize(
    ("closes", "period", "want"),
    [(range(1, 9), 6, [None] * 6 + [100.0] * 2), ([1, 2, 1, 3, 2, 4], 3, [None] * 3 + [75.0, 54.54545454545455, 75.0]), ([5, 5, 5, 5], 3, [None] * 3 + [50.0]), ([1, 2, 3], 3, [None] * 3)],
)
def test_rsi(spark, closes, period, want):
    assert column(S.rsi(series(spark, closes), "close", period), f"RSI{period}") == pytest.approx(want)


def test_kdj(spark):
    flat = S.kdj(series(spark, [10] * 12, high="close", low="close"), 9)
    assert [column(flat, c) for c in "KDJ"] == [[None] * 8 + [50.0] * 4] * 3
    rising = S.kdj(series(spark, range(1, 11), high="close", low=0.0), 9)
    assert column(rising, "K")[8:] == pytest.approx([200 / 3, 700 / 9]) and column(rising, "D")[8:] == pytest.approx([500 / 9, 1700 / 27]) and column(rising, "J")[8:] == pytest.approx([800 / 9, 2900 / 27])


def test_indicators_refuse_bad_input(spark):
    good = series(spark, range(1, 30), open="close", high="close", low=0.0)
    assert column(S.indicators(good), "MA20")[-1] == pytest.approx(19.5)
    with pytest.raises(ValueError, match="MA5"):
        S.indicators(good.withColumn("MA5", F.lit(1)))
    with pytest.raises(Exception, match="high is below low"):
        S.indicators(good.withColumn("low", F.lit(99.0))).collect()


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 3.0, 4.0), ("a", 6.0, 7.0), ("b", 1.0, 1.0)], "g string, start double, end double")
    assert sorted(map(tuple, intervals.islands(rows, "g").collect())) == [("a", 0.0, 4.0), ("a", 6.0, 7.0), ("b", 1.0, 1.0)]
    assert sorted(map(tuple, intervals.covered(rows, "g").collect())) == [("a", 5.0), ("b", 0.0)]
    assert dict(intervals.peak(rows, "g").collect())["a"] == 2


def test_downsampling_keeps_ends_and_changes(spark):
    rows = spark.createDataFrame([("s", i, "x" if i < 40 else "y") for i in range(100)], "series_id string, ord int, label string")
    got = column(S.downsample(rows, "label", 24), "ord")
    required, optional = {0, 40, 99}, [i for i in range(1, 99) if i != 40]
    assert got == sorted(required | {optional[((p + 1) * len(optional)) // 22] for p in range(21)})
    assert S.downsample(rows.limit(10), "label", 24).count() == 10


def test_funnel_and_saturation(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "u int, s string")
    assert [tuple(r) for r in S.funnel(rows, "u", "s", ("a", "b")).orderBy("place").collect()] == [(0, "a", 2, 1.0), (1, "b", 1, 0.5)]
    rounds = spark.createDataFrame([(i, f"f{i}", f"c{i}", 0, 0, 0, True) for i in range(4)], "ord int, query_family string, source_class string, new_valid_urls int, new_entities int, new_fields int, mostly_duplicates boolean")
    assert S.saturated(rounds).first()[0] and not S.saturated(rounds.limit(2)).first()[0] and not S.saturated(rounds.withColumn("new_entities", F.lit(1))).first()[0]


def test_ranking(spark):
    ones = F.create_map(*[F.lit(x) for n in ranking.WEIGHTS for x in (n, 3.0)])
    assert spark.range(1).select(ranking.direction_score(ones)).first()[0] == 3.0
    rows = spark.createDataFrame([("x", "a", 9), ("y", "a", 8), ("z", "b", 1)], "id string, g string, v int")
    assert [r.id for r in ranking.diverse_top(rows, "g", [F.desc("v")], 2).collect()] == ["x", "z"]
    big = {f"a{i}": [str(v) for v in range(100)] for i in range(3)}
    window = ranking.product(spark, big, offset=999_990, limit=16).orderBy("ordinal").collect()
    assert ranking.product_size(list(big.values())) == 1_000_000 and len(window) == 10 and tuple(window[0])[1:] == ("99", "99", "90")
    matrix = ranking.query_matrix(spark, {"t": ["a", "b", "a"], "l": [], "q": ["x"]}, ["old"]).orderBy("ordinal").collect()
    assert [r.query for r in matrix] == ["a x -old", "b x -old"]
    head, last = ranking.batch(spark.range(10).withColumnRenamed("id", "k"), "k", 6, 3)
    assert [r.k for r in head.collect()] == [7, 8, 9] and last.first().exhausted
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (3,), (7,), (11,), (450,)], "v int").select(ranking.nice_ceiling(F.col("v"))).collect()] == [1, 1, 4, 8, 20, 500]
    seeds = spark.createDataFrame([("s",), ("t",)], "seed string")
    assert sorted(r.query for r in ranking.expand_seeds(seeds, seeds.where("seed = 't'"), spark.createDataFrame([("s new",)], "query string"), ("new", "used")).collect()) == ["s", "s used"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, ord int")
    assert sorted(map(tuple, upserts.upsert(old, new, ["k"], "ord").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in upserts.insert_or_ignore(old, new, ["k"], "ord").collect()) == [(1, "a"), (2, "b"), (3, "e")]
    pool = spark.createDataFrame([("p", "1", "kept", []), ("q", "1", "kept", [])], "id string, ver string, status string, history array<struct<status:string,was:string>>")
    got = {r.id: r for r in upserts.upsert_with_history(pool, spark.createDataFrame([("p", "2"), ("r", "1")], "id string, ver string"), "id", ["ver"]).collect()}
    assert (got["p"].status, got["p"].history[0].status, got["q"].status, got["r"].status) == ("pending", "kept", "kept", "pending")
    rows, audit = upserts.delete_with_audit(old, spark.createDataFrame([(1, ["x"]), (2, []), (9, ["y"])], "k int, evidence array<string>"), "k")
    assert [r.k for r in rows.collect()] == [2] and sorted((r.k, r.found) for r in audit.collect()) == [(1, True), (9, False)]
    known = spark.createDataFrame([("o", ["u1"], "a")], "object_id string, evidence_urls array<string>, name string")
    merged = upserts.merge_objects(known, spark.createDataFrame([("o", ["u2"], None), ("n", ["u3"], "b")], known.schema)).orderBy("object_id").collect()
    assert [tuple(r) for r in merged] == [("n", ["u3"], "b"), ("o", ["u1", "u2"], "a")]


def test_graph(spark):
    parts = spark.createDataFrame([("a", [], True), ("b", ["a"], True), ("c", ["b"], False), ("d", ["c"], True), ("x", ["y"], True), ("y", ["x"], True), ("m", ["gone"], True)], "id string, requires array<string>, own boolean")
    order = {r.id: (r["rank"], r.problem) for r in graph.dependency_order(parts).collect()}
    assert order == {"a": (0, None), "b": (1, None), "c": (2, None), "d": (3, None), "x": (None, "cycle"), "y": (None, "cycle"), "m": (None, "missing dependency")}
    states = dict(graph.verified_states(parts).collect())
    assert states == {"a": "verified", "b": "verified", "c": "pending", "d": "pending", "x": "pending", "y": "pending", "m": "pending"}
    assert sorted(r.node for r in graph.audit_scope(parts, spark.createDataFrame([("b",)], "node string")).collect()) == ["a", "b", "c", "d"]
    files = spark.createDataFrame([("r.md", "see a.md"), ("x/a.md", "then b.py"), ("b.py", ""), ("c.md", "alone")], "path string, content string")
    assert sorted(r.node for r in graph.mentioned_files(files, ["r.md"]).collect()) == ["b.py", "r.md", "x/a.md"]


def test_joins(spark):
    rows = spark.createDataFrame([("git-push",), ("pytest-x",), ("other",)], "name string")
    rules = spark.createDataFrame([("git-", "git", 2), ("pytest-", "py", 1), ("g", "early", 1)], "prefix string, value string, ord int")
    assert sorted(((r.name, r.value) for r in joins.longest_prefix(rows, "name", rules).collect()), key=str) == [("git-push", "early"), ("other", None), ("pytest-x", "py")]
    pages = spark.createDataFrame([(1, "a b c a b".split())], "page int, tokens array<string>")
    quotes = spark.createDataFrame([("q", ["a", "b"]), ("z", ["c", "b"])], "quote string, tokens array<string>")
    assert sorted(map(tuple, joins.occurrences(pages, quotes).collect())) == [(1, "q", 0), (1, "q", 3)]
    tree = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert [r.path for r in joins.unexpected(tree("a"), tree("a", "b\\c", "d"), tree("d")).collect()] == ["b/c"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.outcome for r in joins.classify_after_write(ids("a"), ids("a", "b")).collect()} == {"duplicate"}


def test_ledger_failures(spark):
    rows = spark.createDataFrame([("b1", "rate_limited", "p"), ("b1", "rate_limited", "p"), ("b2", "page_exhausted", "q")], "batch_id string, category string, parameter_digest string")
    known = ledger.append_failures(rows.limit(0).withColumn("failure_id", F.lit("")), rows)
    assert known.count() == 2 and ledger.append_failures(known, rows).count() == 2
    assert {r.category: r.disposition for r in ledger.with_disposition(rows).collect()} == {"rate_limited": "hard_block", "page_exhausted": "rotate_family"}


def test_decisions(spark):
    run = spark.createDataFrame([(60.0, 600, 300, 12.0, 700, {"jd": "ok"}, None), (60.0, 600, 300, 40.0, 700, {"jd": "ok"}, None), (700.0, 7000, 300, 1.0, 8000, {"jd": "ok"}, None), (60.0, 600, 3, 1.0, 90000, {"jd": "ok"}, None), (60.0, 600, 300, 1.0, 700, {"jd": "captcha"}, None)], "discovery_seconds double, total_unique_candidates int, recent_window_candidates int, max_zero_gap_seconds double, raw_observations int, source_states map<string,string>, scope struct<recent_candidate_additions:array<bigint>,query_generation_exhausted:boolean,healthy_cursors_open:int,healthy_cursors_blocked:int,edge_plan_completed:boolean,api_available:boolean,api_cursor_completed:boolean,untried_high_yield_families:int>")
    got = [(r.state, r.acceptance_passed) for r in E.marketplace_state(run).collect()]
    assert got == [("healthy", False), ("zero_window", False), ("ten_minute_limit", True), ("duplicate_saturation", False), ("source_blocked", False)]
    backends = "array<struct<name:string,kind:string,available:boolean,attempted:boolean>>"
    routes = spark.createDataFrame([(4.0, 9, 0, 1.0, 0, []), (10.0, 2, 900, 5.0, 400, []), (20.0, 2, 10, 5.0, 1, [("B", "sitemap", True, False), ("a", "dataset", True, False)]), (20.0, 2, 10, 5.0, 1, [("b", "sitemap", True, True)]), (10.0, 2, 10, 5.0, 1, [])], f"discovery_seconds double, batches int, raw int, recent_seconds double, recent_raw int, backends {backends}")
    assert [(r.action, r.backend, r.reason, r.must_disclose) for r in E.throughput_route(routes).collect()] == [("continue", None, "warmup", False), ("continue", None, "target-met", False), ("add_bulk_backend", "a", "below-target-add-bulk-backend", True), ("switch_query_family", None, "bulk-backends-exhausted", True), ("search_only_degraded", None, "bulk-backend-unavailable", False)]
    eav = E.snapshot(E.atoms(spark.createDataFrame([(1, "x", 2.0)], "id int, a string, b double"), ["id"], ["a", "b"])).first()
    assert (eav.entity, eav.fields) == ("1", {"a": ["x"], "b": ["2.0"]})


def test_reviews_batches_and_invalidation(spark):
    pool = spark.createDataFrame([("p", "pending", []), ("q", "pending", [])], "id string, status string, history array<struct<status:string,was:string>>")
    kind = "id string, status string, evidence string"
    got = {r.id: (r.status, len(r.history)) for r in upserts.review(pool, spark.createDataFrame([("p", "adopted", "e")], kind)).collect()}
    assert got == {"p": ("adopted", 1), "q": ("pending", 0)}
    with pytest.raises(Exception, match="no such review"):
        upserts.review(pool, spark.createDataFrame([("p", "adopted", "")], kind)).collect()
    index = spark.createDataFrame([("i1", "b1", ["a"], None, "open"), ("i2", "b2", ["a"], None, "open")], "logical_id string, batch_id string, tags array<string>, verified_at string, status string")
    frozen = {r.logical_id: (r.tags, r.verified_at, r.status) for r in upserts.freeze_batch(index, spark.createDataFrame([("i1", ["x"])], "logical_id string, tags array<string>"), "b1", "2024-01-02").collect()}
    assert frozen == {"i1": (["x"], "2024-01-02", "frozen"), "i2": (["a"], None, "open")}
    needs = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", [])], "id string, requires array<string>")
    proof = spark.createDataFrame([("e1", "a", "x.py"), ("e2", "b", "y.py"), ("e3", "c", "z.py")], "id string, requirement string, path string")
    good, stale = graph.invalidate(proof, needs, spark.createDataFrame([("x.py",)], "path string"))
    assert [r.id for r in good.collect()] == ["e3"] and sorted(r.id for r in stale.collect()) == ["e1", "e2"]


def test_deep_graph(spark):
    chain = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(54)], "id int, requires array<int>")
    assert {r.id: (r["rank"], r.problem) for r in graph.dependency_order(chain).collect()} == {i: (i, None) for i in range(54)}
    edges = spark.range(104).selectExpr("id as src", "id + 1 as dst")
    assert graph.closure(edges, spark.createDataFrame([(0,)], "node long")).count() == 105
    with pytest.raises(RuntimeError):
        graph.closure(edges, spark.createDataFrame([(0,)], "node long"), depth=3)
