"""What raw web pages hold: titles, metadata, headings, links; sitemaps and robots files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import REFERENCES, unescaped
from plumbline.functions.urls import resolve_root_relative


def title(html: Column, names: tuple[str, ...] = tuple(REFERENCES)) -> Column:
    """The title, with the character references of these names resolved."""
    return F.trim(unescaped(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1), names))


def headings(html: Column) -> Column:
    """The opening tags of headings."""
    return F.regexp_extract_all(html, F.lit("<h[1-6][^>]*>"), 0)


def links(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, at, href, label and target (absolute; null for schemes other than HTTP) of every link."""
    tags = F.regexp_extract_all(html_col, F.lit(r'<a\s[^>]*href="[^"]*"[^>]*>[^<]*'), 0)
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.posexplode(tags).alias("at", "tag"))
    href = F.regexp_extract("tag", 'href="([^"]*)"', 1)
    return found.select("page_id", "url", "at", href.alias("href"), F.trim(unescaped(F.regexp_extract("tag", ">([^<]*)$", 1))).alias("label")).withColumn("target", resolve_root_relative(F.col("url"), F.col("href")))


META = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "abstract", "doi", "date", "venue")])


@F.pandas_udf(META)
def page_metadata(html: pd.Series) -> pd.DataFrame:
    """Title, abstract, DOI, date and venue from a page's meta elements; the description where no abstract is named."""
    import re
    from html.parser import HTMLParser

    # Names of meta elements, in order of preference.
    wanted = {
        "title": ("citation_title", "dc.title", "og:title"),
        "abstract": ("citation_abstract", "dc.description", "description", "og:description"),
        "doi": ("citation_doi", "dc.identifier"),
        "date": ("citation_publication_date", "citation_date", "dc.date"),
        "venue": ("citation_conference_title", "citation_journal_title"),
    }

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = {}

        def handle_starttag(self, tag, attrs):
            held = dict(attrs)
            name = (held.get("name") or held.get("property") or "").lower()
            if tag == "meta" and name:
                self.found.setdefault(name, " ".join((held.get("content") or "").split()))

    def read(page):
        reader = Reader()
        reader.feed(page or "")
        out = [next((reader.found[n] for n in names if reader.found.get(n)), "") for names in wanted.values()]
        number = re.search(r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", out[2])
        return [*out[:2], number[0].rstrip(".,;") if number else "", *out[3:]]

    return pd.DataFrame(list(map(read, html)), columns=META.names)


def robots_sitemaps(text: Column) -> Column:
    """The URLs of a robots file's Sitemap lines, in order, each once."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.regexp_extract(line, r"(?i)^\s*sitemap\s*:\s*(\S+)", 1))
    return F.array_distinct(F.filter(lines, lambda u: u != ""))


SITEMAP = "kind string, child_sitemaps array<string>, primary_urls array<string>, media_urls array<string>, problem string"


def parse_sitemaps(files: DataFrame, most: int = 50_000_000) -> DataFrame:
    """What each sitemap (path, content) holds: an index's children, or a set's pages and media; gzip is undone up to a bound.

    problem says why a file could not be read: too large, no gzip, no XML, or another root.
    """

    def local(tag: str) -> str:
        return tag.rpartition("}")[2].lower()

    def unpack(raw: bytes) -> bytes:
        import zlib

        if raw[:2] != b"\x1f\x8b":
            return raw
        feed = zlib.decompressobj(31)
        out = feed.decompress(raw, most + 1)
        if len(out) > most or feed.unconsumed_tail:
            raise OverflowError
        return out

    def parse(raw: bytes) -> tuple:
        try:
            body = unpack(raw or b"")
            if len(body) > most:
                raise OverflowError
            root = ElementTree.fromstring(body)
        except OverflowError:
            return None, [], [], [], "too-large"
        except ElementTree.ParseError:
            return None, [], [], [], "invalid-xml"
        except Exception:  # noqa: BLE001  zlib has its own error class
            return None, [], [], [], "invalid-gzip"
        kind = {"sitemapindex": "index", "urlset": "urlset"}.get(local(root.tag))
        if kind is None:
            return None, [], [], [], "unknown-root"
        own, media = [], []
        for entry in root:
            for item in entry.iter():
                if local(item.tag) == "loc" and (item.text or "").strip():
                    (own if item in list(entry) else media).append(item.text.strip())
        return kind, own if kind == "index" else [], own if kind == "urlset" else [], media, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "kind", "child_sitemaps", "primary_urls", "media_urls", "problem"]
        strings = pa.list_(pa.string())
        for batch in batches:
            rows = [parse(raw) for raw in batch.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), strings, strings, strings, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, " + SITEMAP)


def sitemap_tree(edges: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """url, depth and rank of the sitemaps that a root reaches over (parent, child) edges, each at its least depth."""
    from plumbline.operators.graph import reachable

    return reachable(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), [root], depth)


def sitemap_completion(parsed: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """url, depth and complete of the sitemaps that the seeds (url, origin) reach: all that a complete one names was read, at any depth.

    parsed: path (the sitemap's url), kind, child_sitemaps, problem. A child deeper than `depth` counts as not read, unless it is
    reached by a shorter way. Names are compared as canonical sitemap URLs.
    """
    from plumbline.operators.graph import complete_upward, steps_from

    edges = parsed.where("problem is null and kind = 'index'").select(F.col("path").alias("parent"), F.explode("child_sitemaps").alias("child")).distinct()
    near = steps_from(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), seeds.select(F.col("url").alias("node")).distinct(), depth)
    read = near.join(parsed.select(F.col("path").alias("node"), F.col("problem").isNull().alias("whole")), "node", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    own = edges.join(near.select(F.col("node").alias("parent")), "parent", "left_semi")
    told = complete_upward(read.select("node", "whole"), own)
    return near.join(told, "node").select(F.col("node").alias("url"), "depth", "complete")


def exhaustive_origins(completion: DataFrame, seeds: DataFrame) -> DataFrame:
    """Origins of which some seed is complete."""
    return seeds.join(completion.where("complete").select("url"), "url", "left_semi").select("origin").distinct()


def url_events(parsed: DataFrame, backend: str = "sitemap") -> DataFrame:
    """Events of the shared protocol: a row for each page URL, and one summary a sitemap after them."""
    pages = parsed.select("path", F.posexplode("primary_urls").alias("ord", "url")).select("path", F.lit("url").alias("type"), "url", F.lit(backend).alias("backend"), F.col("ord").cast("long"), F.lit(None).cast("string").alias("end_reason"))
    ends = parsed.select("path", F.lit("summary").alias("type"), F.lit(None).cast("string").alias("url"), F.lit(backend).alias("backend"), F.size("primary_urls").cast("long").alias("ord"), F.coalesce("problem", F.lit("exhausted")).alias("end_reason"))
    return pages.unionByName(ends)
