import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import urls

SAME = {
    "HTTP://Shop.Example.NET:80/Part/7?z=9&gclid=q&b=1#top": "http://shop.example.net/Part/7?b=1&z=9",
    "https://shop.example.net:443": "https://shop.example.net/",
    "https://shop.example.net:9001/cart": "https://shop.example.net:9001/cart",
    "  https://shop.example.net/list?page=2&&sort ": "https://shop.example.net/list?page=2&sort=",
    "https://shop.example.net/tags?t=red&t=blue&a=0": "https://shop.example.net/tags?a=0&t=red&t=blue",
    "https://shop.example.net/tags?t=blue&t=red&a=0": "https://shop.example.net/tags?a=0&t=blue&t=red",
    "https://shop.example.net/s?word=un%20d%C3%BC*~&UTM_Medium=mail": "https://shop.example.net/s?word=un+d%C3%BC%2A~",
}
INVALID = ["https://shop.example.net/?w=5%", "https://shop.example.net/?w=%G1", "https://shop.example.net/?w=%C3%28", "https://me:pw@shop.example.net/", "https://bücher.example/", "https://shop example.net/", "https://shop.example.net%3A80/", "https://shop.exam\rple.net/", "https://shop.example.net:http/", "mailto:a@example.net", " ", "https://?q", "https://shop-.net/"]


@pytest.mark.parametrize("form", [urls.canonical_url, urls.canonical_url_exact])
def test_canonical(spark, form):
    rows = [*SAME, *INVALID, None]
    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in rows], "u string").select("u", form(F.col("u")).alias("c")).collect()}
    assert {u: got[u] for u in SAME} == SAME
    assert {u: got[u] for u in [*INVALID, None]} == dict.fromkeys([*INVALID, None])


def test_canonical_is_stable(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.canonical_url(F.col("url")).alias("a"), urls.canonical_url_exact(F.col("url")).alias("x"))
    assert frame.where("a is null or a != x").count() == 0
    assert frame.where(urls.canonical_url(F.col("a")) != F.col("a")).count() == 0


def test_other_forms(spark):
    row = spark.range(1).select(
        urls.corpus_url(F.lit(" HTTPS://Example.com/A/?q#f ")).alias("corpus"),
        urls.corpus_url(F.lit("10.1/x/")).alias("loose"),
        urls.reversed_host(F.lit("a.b.c")).alias("back"),
        urls.origin(F.lit("https://A.com/x")).alias("origin"),
        urls.is_official(F.lit("https://www.doi.org/x")).alias("not_doi"),
        urls.is_official(F.lit("https://doi.org/10.1/x")).alias("doi"),
        urls.is_official(F.lit("https://sub.nature.com/x")).alias("below"),
        urls.is_official(F.lit("https://arxiv.org/abs/1")).alias("preprint"),
        urls.is_reviewed_fulltext(F.lit("https://export.arxiv.org/abs/1")).alias("full"),
        urls.unique_numeric_parameter(F.lit("https://x.com/i?id=12&a=1")).alias("one"),
        urls.unique_numeric_parameter(F.lit("https://x.com/i?id=12&id=13")).alias("two"),
        urls.sitemap_url(F.lit("HTTP://A.com:80?b=2&a=1#x")).alias("sitemap"),
        F.hex(urls.url_fingerprint(F.lit("https://example.com/"))).alias("print"),
    ).first()
    assert row.asDict() == {"corpus": "https://example.com/a", "loose": "10.1/x", "back": "c.b.a", "origin": "https://a.com", "not_doi": False, "doi": True, "below": True, "preprint": False, "full": True, "one": "12", "two": None, "sitemap": "http://a.com/?b=2&a=1", "print": row.print}
    assert len(row.print) == 32


def test_public_hosts():
    got = urls.is_public_url.func(pd.Series(["https://example.com/x", "http://localhost/", "http://10.0.0.1/", "http://8.8.8.8/", "ftp://example.com", "http://[::1]/", None, "http://user@example.com/", "http://printer.local/"]))
    assert got.tolist() == [True, False, False, True, False, False, False, False, False]
