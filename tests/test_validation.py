from pyspark.sql import functions as F

from plumbline.operators import validation as V


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_ledger_and_relations(spark):
    kind = "page int, text_read boolean, figures_checked string, captions_checked string, unresolved array<string>, figure_audits array<string>"
    pages = spark.createDataFrame([(1, True, "not_present", "not_present", [], []), (2, False, "checked", "not_present", ["x"], []), (2, True, "checked", "checked", [], ["a"])], kind)
    got = sorted(map(tuple, V.ledger_faults(pages, 3).collect()))
    assert got == [(2, "checked figures require audits"), (2, "figures require checked captions"), (2, "page is repeated or unknown"), (2, "text_read is not true"), (2, "unresolved: x"), (3, "page is missing")]
    items = spark.createDataFrame([("g", "predicate", "t"), ("g", "entity", "t"), ("h", "entity", "t"), ("h", "entity", "u")], "group_id string, role string, type string")
    assert sorted(map(tuple, V.relation_faults(items).collect())) == [("h", "inconsistent types"), ("h", "requires at least one predicate")]
    assert one(spark, V.comment_faults(F.lit("结论：x\n机制：y"))) == [] and one(spark, V.comment_faults(F.lit("x"))) == ["first line is no conclusion", "no analysis after the conclusion"]


def test_papers(spark):
    pair = ("c_title string, c_author string, c_venue string, c_year string, t_title string, t_author string, t_venue string, t_year string")
    rows = [("Deep Flight", "li", "icra", "2024", "Deep flight!", "Li Wei", "ICRA 2024", "2024"), ("Deep Flight", "xu", "icra", "2024", "Deep Flight", "Li", "ICRA", "2024"), ("Deep Flight", "", "", "2024", "Deep Flight", "", "", "2024"), ("Other", "li", "icra", "2024", "Deep Flight", "Li", "ICRA", "2024")]
    assert [r.accepted for r in V.accept_doi(spark.createDataFrame(rows, pair)).collect()] == [True, False, True, False]
    assert one(spark, V.title_matches(F.lit("Deep flight of drones"), F.lit("deep drones flight v2"))) and not one(spark, V.title_matches(F.lit("Deep flight"), F.lit("cooking pasta")))
    assert one(spark, V.is_pdf(F.lit(b"%PDF-1.7" + b"x" * 300))) and not one(spark, V.is_pdf(F.lit(b"%PDF-1.7"))) and not one(spark, V.is_pdf(F.lit(b"<html>" + b"x" * 300)))
    paper = spark.createDataFrame([("", "https://ieeexplore.ieee.org/document/12/", "https://x.org/a.PDF"), ("https://arxiv.org/pdf/1", "https://proceedings.mlr.press/v1/a.html", "")], "formal_pdf_url string, source_url string, url string")
    assert [r.candidates for r in V.pdf_addresses(paper).collect()] == [["https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=12&ref=", "https://x.org/a.PDF"], ["https://proceedings.mlr.press/v1/a.pdf"]]
    assert one(spark, V.pdf_rect(F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0))), F.array(*map(F.lit, (0.0, 0.0, 600.0, 800.0))))) == [10.0, 760.0, 30.0, 780.0]
    assert one(spark, V.sort_index(F.lit(3), F.lit(42), F.lit(7))) == "00003|000042|00007"
    assert one(spark, V.source_line(F.lit("text ^paper-1"), F.lit("K"))) == "text, [PDF](library://items/K) ^paper-1"


def test_backends_and_files(spark):
    rows = spark.createDataFrame([("search", "site", 1, 9, 99.0, 0), ("map", "site", 1, 9, 0.0, 0), ("map", "open", 1, 9, 60.0, 0), ("map", "open", 1, 9, 1.0, 2), ("map", "open", 1, 0, 1.0, 2), ("map", "site", 0, 9, 99.0, 9)], "source_kind string, scope_mode string, valid_sitemaps int, primary_urls int, raw_rate double, exhaustive_seeds int")
    assert [r.x for r in rows.select(V.bulk_readiness().alias("x")).collect()] == ["bulk_unavailable", "bulk_ready", "bulk_ready", "bulk_ready", "bulk_degraded", "bulk_unavailable"]
    assert one(spark, V.product_evidence(F.lit("https://Shop.com/p/1"), F.lit("https://x.com/products-1.xml"), ["/p/"], ["shop.com"])) == ["sitemap_product_shard", "url_path_hint", "product_hostname"]
    files = spark.createDataFrame([("keep/x.pyc", 1), ("a/__pycache__/m.pyc", 2), ("old/a.txt", 3), ("src/a.py", 4), ("b.txt", 5), ("t.out", 6)], "path string, size int")
    assert {r.path: r["class"] for r in V.workspace(files, ["keep"], finished=["t.out"]).collect()} == {"keep/x.pyc": "protected", "a/__pycache__/m.pyc": "auto", "old/a.txt": "proposal", "src/a.py": "protected", "b.txt": "protected", "t.out": "auto"}
    gates = spark.createDataFrame([("a", "1", False, False), ("b", "2", False, False), ("c", "3", True, False)], "gate string, fingerprint string, final boolean, affected boolean")
    cache = spark.createDataFrame([("a", "1", True), ("b", "9", True), ("c", "3", True)], "gate string, fingerprint string, passed boolean")
    assert sorted(r.gate for r in V.gates_to_run(gates, cache).collect()) == ["b", "c"]
    assert [r.claim for r in V.unsupported_claims(spark.createDataFrame([("x", "u1"), ("y", "u2"), ("z", "u3")], "claim string, url string"), spark.createDataFrame([("u0", "u1", True), ("u2", "q", False), ("u3", "w", True)], "requested string, final string, ok boolean")).collect()] == ["y"]
    changes = V.generated_changes(spark.createDataFrame([("a", "1"), ("b", "2")], "name string, digest string"), spark.createDataFrame([("a", "0"), ("c", "3")], "name string, digest string"))
    assert dict(map(tuple, changes.collect())) == {"a": "changed", "b": "new", "c": "retired"}
    assert V.resources(8, 1000, 8000, broad=True)["spark.sql.shuffle.partitions"] == "4"


def test_reports_and_states(spark):
    kind = "run_type string, stop string, seconds double, candidates int, average_rate double, zero_gap double, previous int, new int, invalid int, cumulative int, invalidations int, sources array<string>"
    rows = [("bounded", "ten_minute_limit", 600.0, 6000, 10.0, 1.0, 5, 3, 1, 7, 1, ["https://a"]), ("saturation", "deterministic_scope_complete", 10.0, 5, 2.0, 1.0, 5, 3, 1, 8, 0, [])]
    got = [r.x for r in spark.createDataFrame(rows, kind).select(V.report_faults().alias("x")).collect()]
    assert got == [[], ["stop does not fit the run type", "rate does not fit", "cumulative does not add up", "invalidation without evidence", "no source"]]
    assert one(spark, V.statistic(F.lit("# s\n-  seconds: 12 s\n- other: x"), "seconds")) == "12 s"
    kind = "status string, expected_effect string, regression_test string, domain_semantics boolean, reuse_failures int, promotion string, policy string, auto_apply boolean, canonical boolean"
    rows = [("verified", "e", "t", False, 0, None, "full", True, True), ("verified", "", "", False, 0, None, "lightweight", False, True), ("observed", "", "", True, 1, "applied", "lightweight", True, False)]
    got = [(r.eligible, r.stage, len(r.reasons), r.allow_auto_apply) for r in V.promotion(spark.createDataFrame(rows, kind)).collect()]
    assert got == [(True, "ready-for-permanent-fix", 0, True), (True, "ready-for-lightweight-permanent-fix", 1, False), (False, "temporary", 7, False)]
    needs = spark.createDataFrame([("a", ["k"]), ("b", ["k", "l"]), ("c", ["k"])], "id string, needs array<string>")
    held = spark.createDataFrame([("a", "k", False), ("b", "k", False), ("c", "k", True)], "requirement string, kind string, stale boolean")
    states = V.requirement_states(needs, held)
    assert dict(map(tuple, states.collect())) == {"a": "verified", "b": "partial", "c": "pending"}
    assert dict(map(tuple, V.gate_states(spark.createDataFrame([("g", "a"), ("h", "a"), ("h", "b")], "gate string, requirement string"), states).collect())) == {"g": True, "h": False}
    index = spark.createDataFrame([("image-0001", "a.png", "s", "batch-001", 1), ("image-0003", "b.png", "s", "batch-001", 3)], "logical_id string, filename string, sha256 string, batch_id string, position int")
    assert sorted(map(tuple, V.image_faults(index, spark.createDataFrame([("a.png", "t")], "filename string, sha256 string")).collect())) == [("image-0001", "file differs"), ("image-0003", "file is gone"), ("image-0003", "numbers do not go on")]
