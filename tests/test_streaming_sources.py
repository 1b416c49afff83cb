import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import corpus
from plumbline.sources import files, index, pages
from plumbline.streaming import controllers as C
from plumbline.streaming import ingest, windows

SIGNAL = "backend string, ord long, tool_limit int, host_limit int, rate_limited boolean, rate_limit_streak int, error_rate double, latency_ratio double, window_complete boolean, failed int"


def signals():
    calm, bad = (False, 0, 0.0, 1.0), (False, 0, 0.2, 1.0)
    return [("b", 1, 64, 64, *calm, True, 0), ("b", 2, 64, 64, *calm, False, 1), ("b", 3, 64, 64, *bad, True, 2), ("b", 4, 64, 64, *calm, True, 0), ("b", 5, 64, 64, *calm, True, 0), ("b", 6, 64, 64, *bad, True, 0), ("b", 7, 16, 64, *calm, True, 0), ("c", 1, 64, 64, True, 1, 0.0, 1.0, True, 0)]


WANT = [("b", 1, 24, 32, "scale-up", 0), ("b", 2, 32, 32, "hold", 1), ("b", 3, 32, 24, "backoff", 3), ("b", 4, 24, 32, "scale-up", 3), ("b", 5, 32, 40, "scale-up", 3), ("b", 6, 40, 32, "retreat-one-tier", 3), ("b", 7, 32, 16, "limit-cap", 3), ("c", 1, 24, 24, "hold", 0)]


def test_concurrency(spark):
    assert sorted(map(tuple, C.concurrency(spark.createDataFrame(signals(), SIGNAL)).collect())) == WANT


def test_concurrency_stream_keeps_state(spark, tmp_path):
    for part in (signals()[:3], signals()[3:]):
        spark.createDataFrame(part, SIGNAL).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = C.concurrency_stream(stream).writeStream.format("memory").queryName("tiers").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {t[:2] for t in map(tuple, spark.table("tiers").collect())} == {w[:2] for w in WANT}
    assert max(r.retained_errors for r in spark.table("tiers").collect()) == 3


def test_pace_and_sizes(spark):
    rows = [("s", 1, 0.0, "healthy", "", None), ("s", 2, 1.0, "healthy", "", None), ("s", 3, 2.0, "warning", "", 3.0), ("s", 4, 3.0, "warning", "", 20.0), ("s", 5, 4.0, "empty", "", None), ("s", 6, 5.0, "empty", "", None), ("s", 7, 10.0, "warning", "captcha_required", None)]
    got = C.pace(spark.createDataFrame(rows, "session string, ord long, at double, outcome string, category string, slow_seconds double")).orderBy("ord").collect()
    assert [r.interval for r in got] == [33.75, 30.0, 30.0, 60.0, 60.0, 120.0, 45.0] and got[-1].cool_until == 130.0
    sizes = C.batch_sizes(spark.createDataFrame([("r", i, y) for i, y in enumerate((0.3, 0.1, 0.3, 0.01, 0.9))], "run string, ord int, yield_ double"))
    assert [r.size for r in sizes.orderBy("ord").collect()] == [16, 32, 32, 64, 8]
    plan = C.continuation(spark.createDataFrame([("r", i, o) for i, o in enumerate(["verified"] * 3 + ["soft_failure"] * 3 + ["hard"])], "run string, ord long, outcome string"), 2, 2).orderBy("ord").collect()
    assert [(r.topic, r.family, r.page, r.done) for r in plan] == [(0, 0, 2, False), (0, 0, 3, False), (0, 1, 1, False), (0, 1, 1, False), (0, 1, 1, False), (1, 0, 1, False), (2, 0, 1, True)]
    gate = C.campaign_gate(spark.createDataFrame([("c", 0.0, False), ("c", 5.0, True), ("c", 20.0, False), ("c", 70.0, False)], "campaign string, started_at double, hard_block boolean"), gap=10, cooldown=60)
    assert [r.may_start for r in gate.orderBy("started_at").collect()] == [True, False, False, True]


def test_batches_count_once(spark, tmp_path):
    kind = "batch_id string, ord long, type string, url string"
    good = spark.createDataFrame([("x", 0, "url", "u"), ("x", 1, "summary", None), ("y", 0, "summary", None)], kind)
    path = str(tmp_path / "ledger")
    assert ingest.committed(spark, path) is None
    for _ in range(2):
        ingest.commit(good, path)
    assert spark.read.parquet(path).count() == 3 and sorted(r.batch_id for r in ingest.committed(spark, path).collect()) == ["x", "y"]
    bad = spark.createDataFrame([("z", 0, "summary", None), ("z", 1, "url", "u"), ("w", 0, "url", "u")], kind)
    assert dict(map(tuple, ingest.protocol_faults(bad).collect())) == {"z": "events after the summary", "w": "no summary"}
    with pytest.raises(ValueError, match="no summary"):
        ingest.commit(bad, path)
    good.write.json(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_stream(spark.readStream.schema(kind).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:05", 1.0, "a"), ("2024-01-01 00:00:40", 2.0, "a"), ("2024-01-01 00:05:00", 4.0, "b")], "t string, v double, k string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.total) for r in windows.tumbling(rows, "ts", "v").collect()) == [(1, 1.0), (1, 2.0), (1, 4.0)]
    assert windows.sliding(rows, "ts", "v", "1 minute", "30 seconds").count() == 5
    assert sorted((r.k, r.n) for r in windows.sessions(rows, "ts", "v", "1 minute", ["k"]).collect()) == [("a", 2), ("b", 1)]
    assert windows.once(rows, ["k"], "ts").count() == 2


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,venue_time,source,abstract,url,citation,lab_group\n" A, b ",2025,ICRA,"x ""q""",https://doi.org/10.1/a,3,L\n,,,,,,\n', encoding="utf-8")
    got = files.read_corpus(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.title, r.abstract, r.doi) for r in got] == [("A, b", 'x "q"', "")]
    assert [r.fault for r in files.corpus_faults(spark, str(tmp_path / "a.csv")).collect()] == ["header: expected exact columns in order"]
    (tmp_path / "c.md").write_text("| h | m |\n|---|---|\n| [T](https://x.org/l) | ICRA 2024-05 | Abs | https://doi.org/10.1/b | cited 7 |\n| [U](https://x.org/u) | arXiv | Abs |  | none |\n", encoding="utf-8")
    rows = files.read_corpus_markdown(spark, str(tmp_path / "c.md")).orderBy("ord").collect()
    assert [(r.title, r.venue_time, r.source, r.url, r.citation, r.lab_group) for r in rows] == [("T", "2024-05", "ICRA", "https://doi.org/10.1/b", "7", "否"), ("U", "", "arXiv", "https://x.org/u", "0", "否")]
    out = tmp_path / "out.csv"
    files.write_corpus(corpus.trimmed(spark.createDataFrame([("T", "2024")], "title string, venue_time string")), str(out))
    assert [r.title for r in files.read_corpus(spark, str(out)).collect()] == ["T"]
    with pytest.raises(ValueError, match="not published"):
        files.write_corpus(corpus.trimmed(spark.createDataFrame([("T", "??")], "title string, method_evidence string")), str(out))
    assert [r.title for r in files.read_corpus(spark, str(out)).collect()] == ["T"] and not list(tmp_path.glob("*.staged-*"))


def test_sitemaps_and_robots(spark):
    urlset = b'<urlset xmlns="x" xmlns:i="y"><url><loc>https://a/1</loc><i:image><i:loc>https://a/p.png</i:loc></i:image></url></urlset>'
    rows = [("i", bytearray(b"<sitemapindex><sitemap><loc> https://a/s.xml </loc></sitemap></sitemapindex>")), ("u", bytearray(gzip.compress(urlset))), ("bad", bytearray(b"<x")), ("other", bytearray(b"<rss/>")), ("bomb", bytearray(gzip.compress(b"0" * 9000)))]
    got = {r.path: r for r in pages.parse_sitemaps(spark.createDataFrame(rows, "path string, content binary"), most=8192).collect()}
    assert (got["i"].kind, got["i"].child_sitemaps) == ("index", ["https://a/s.xml"])
    assert (got["u"].primary_urls, got["u"].media_urls) == (["https://a/1"], ["https://a/p.png"])
    assert [got[k].problem for k in ("bad", "other", "bomb")] == ["invalid-xml", "unknown-root", "too-large"]
    assert spark.range(1).select(pages.robots_sitemaps(F.lit("User-agent: *\nSITEMAP: https://a/s.xml\nsitemap: https://a/s.xml\n"))).first()[0] == ["https://a/s.xml"]
    tree = pages.sitemap_tree(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r")], "parent string, child string"), "r", 3)
    assert dict(map(tuple, tree.collect())) == {"r": 0, "a": 1, "b": 2}
    page = '<html><meta name="citation_title" content="T  x"><meta name="description" content="D"><meta name="citation_doi" content="doi:10.1000/q."></html>'
    assert tuple(spark.createDataFrame([(page,)], "h string").select(pages.page_metadata("h").alias("m")).first().m) == ("T x", "D", "10.1000/q", "", "")


def test_pruned_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://{h}/x", ".".join(reversed(h.split(".")))) for h in ("a.example.com", "b.example.com", "z.other.org", "example.com")], "url string, url_host_name_reversed string")
    for n, part in enumerate(("com.", "org.")):
        rows.where(F.col("url_host_name_reversed").startswith(part)).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
    paths = sorted(str(p) for p in tmp_path.glob("p*/*.parquet"))
    shards = index.footer_map(spark, paths)
    assert {(r.min_host, r.max_host) for r in shards.collect()} == {("com.example", "com.example.b"), ("org.other.z", "org.other.z")}
    found = index.pruned_scan(spark, shards, "subdomain", "example.com")
    assert sorted(r.url for r in found.collect()) == ["https://a.example.com/x", "https://b.example.com/x"] and len(found.inputFiles()) == 1
    assert index.pruned_scan(spark, shards, "domain", "nowhere.net") is None
    assert index.check_shard_map(shards, shards.limit(1)).count() == 1
    (tmp_path / "r.json").write_text('{"url":"a"}\n{"url":"b')
    assert [r.url for r in index.read_results(spark, str(tmp_path / "r.json"), "url string").collect()] == ["a"]


def test_many_targets_prune_files_at_once(spark, tmp_path, monkeypatch):
    hosts = [f"{a}{n}.site{n % 40:02}.{t}" for n in range(120) for a in ("www.", "") for t in ("com", "org")]
    rows = spark.createDataFrame([(f"https://{h}/{'x' if n % 2 else 'y'}/{n}", ".".join(reversed(h.split("."))), "drop") for n, h in enumerate(hosts)], "url string, url_host_name_reversed string, other string")
    rows.repartitionByRange(12, "url_host_name_reversed").write.parquet(str(tmp_path / "i"))
    paths = sorted(f"file://{p}" for p in tmp_path.glob("i/*.parquet"))
    shards = index.range_map(spark, paths)
    assert {tuple(r)[1:] for r in shards.collect()} == {tuple(r)[1:] for r in index.footer_map(spark, paths).collect()} and shards.count() > 6
    asked = [("d", "domain", "site07.org"), ("s", "subdomain", "site07.org"), ("e", "exact", "https://www.3.site03.com/x/13"), ("p", "prefix", "https://5.site05.com/"), ("none", "domain", "nowhere.net"), ("up", "domain", "www.7.site07.org")]
    targets = spark.createDataFrame(asked, "target_id string, kind string, target string")
    files = index.files_of_targets(shards, index.targets_of(targets))
    by_target = {}
    for r in files.collect():
        by_target.setdefault(r.target_id, set()).add(r.file_name)
    assert "none" not in by_target and len(by_target["d"]) < len(paths) / 2
    for i, kind, target in asked:  # no more than the filter of one target, and all that it finds
        assert by_target.get(i, set()) <= {r.file_name for r in index.overlapping(shards, kind, target).collect()}
    assert sorted(map(tuple, index.files_of_targets(shards, index.targets_of(targets), block=2).collect())) == sorted(map(tuple, files.collect()))
    found = index.read_targets(spark, shards, targets)
    assert "other" not in found.columns and len(found.inputFiles()) < len(paths)
    got = {}
    for r in found.collect():
        got.setdefault(r.target_id, set()).add(r.url)
    urls = {r.url for r in rows.collect()}
    assert got["d"] == got["s"] == {u for u in urls if ".site07.org/" in u} and got["up"] == {u for u in urls if "//www.7.site07.org/" in u}
    assert got["p"] == {u for u in urls if u.startswith("https://5.site05.com/")} and got.get("e", set()) == {u for u in urls if u == "https://www.3.site03.com/x/13"}
    ends = {r.target_id: (r.captures, r.end_reason) for r in index.target_events(spark, shards, targets, limit=2).where("type = 'summary'").collect()}
    assert ends["d"] == (2, "limit") and ends["none"] == (0, "exhausted")
    assert index.read_targets(spark, shards, targets.where("target_id = 'none'")).count() == 0


def test_payloads(spark):
    body = json.dumps({"results": [{"url": "https://a", "title": "t", "content": "c", "engine": "x", "engines": ["y", "x"], "positions": [0, 3, 2]}]})
    got = files.run_adapter("search_results", spark.createDataFrame([("q", body)], "query string, body string")).first()
    assert (got.engines, got["rank"]) == (["x", "y"], 2)
    work = json.dumps({"title": ["T"], "DOI": "10.1/AB", "container-title": ["V"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2024, 5]]}})
    assert tuple(files.bibliographic(spark.createDataFrame([(work,)], "body string")).first())[2:] == (2024, "V", ["A B"])
    batch = json.dumps({"platform": "p", "page_state": "ready", "query_family": "f", "items": [{"product_id": "1", "title": "a"}, {"product_id": "1", "title": "b"}, {"product_id": "x"}]})
    items, ends = files.product_batches(spark.createDataFrame([("b", batch)], "batch_id string, body string"))
    assert [r.title for r in items.collect()] == ["a"] and ends.first().seen == 3
    health = files.engine_health(spark.createDataFrame([("a",), ("b",), ("c",)], "engine string"), spark.createDataFrame([("b", "CAPTCHA"), ("c", "Timeout")], "engine string, reason string"))
    assert {r.category: r.engines for r in health.collect()} == {"available": ["a"], "blocked": ["b"], "timeout": ["c"]}


def test_cards_and_reports(spark):
    card = '# T\n## image-0001\ntext\n<!-- {"tag": "x"} -->\n## image-0002\nnone\n'
    got = {r.logical_id: r.metadata for r in files.card_sections(spark.createDataFrame([("c.md", card)], "path string, content string")).collect()}
    assert got == {"image-0001": {"tag": "x"}, "image-0002": None}
    assert spark.range(1).select(files.topics(F.array(F.lit("a, b"), F.lit("b，c")))).first()[0] == ["a", "b", "c"]
    assert files.markdown_table(spark.createDataFrame([("a|b", 1)], "k string, n int")) == "| k | n |\n| --- | --- |\n| a\\|b | 1 |"
    with pytest.raises(ValueError, match="more than"):
        files.markdown_table(spark.range(5), most=4)
    assert files.sparkline([0, 1, 2]) == "▁▄█" and files.sparkline([]) == "" and files.sparkline([3, 3]) == "▁▁"
