"""URL expressions: canonical forms, scopes, hosts and product identities.

Canonical URLs are built from columns alone, so that they stay in generated code and can be pushed around by the
optimizer. canonical_url_exact() is an Arrow kernel for what columns cannot tell: IPv6 hosts and percent escapes that are
no UTF-8. A URL without a canonical form is null.
"""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that only track, besides those that start with utm_.
TRACKING_KEYS = ("fbclid", "gclid", "spm", "yclid")

# Hosts of official records.
OFFICIAL_HOSTS = (
    "doi.org", "ieeexplore.ieee.org", "science.org", "nature.com", "www.nature.com", "openaccess.thecvf.com",
    "cvpr.thecvf.com", "proceedings.mlr.press", "roboticsproceedings.org", "roboticsconference.org",
    "proceedings.neurips.cc", "neurips.cc", "openreview.net", "rssconf.org", "par.nsf.gov", "hub.hku.hk",
    "aerial-core.eu", "nicsefc.ee.tsinghua.edu.cn", "orca.cardiff.ac.uk",
)

LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
DEFAULT_PORTS = {"http": "80", "https": "443"}
MALFORMED_ESCAPE = "%(?![0-9A-Fa-f]{2})"
SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def has_malformed_escape(url: Column) -> Column:
    return url.rlike(MALFORMED_ESCAPE)


def canonical_host(host: Column) -> Column:
    """The lower-cased ASCII host name, null if a label or the whole is out of bounds."""
    low = F.lower(host)
    return F.when(low.rlike(rf"^(?:{LABEL}\.)*{LABEL}$") & (F.length(low) <= 253), low)


def _form_encoded(part: Column) -> Column:
    """Decodes a query part and encodes it again: spaces as +, `~` kept, `*` escaped."""
    encoded = F.url_encode(F.try_url_decode(part))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """Without tracking keys, keys in order, the values of a key in their own; null where an escape is no UTF-8."""
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    raw_key = lambda p: F.substring_index(p, "=", 1)
    raw_value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(raw_key(p)) + 2, F.length(p))).otherwise("")
    split = F.transform(pairs, lambda p, i: F.struct(F.try_url_decode(raw_key(p)).alias("name"), i.alias("at"), _form_encoded(raw_key(p)).alias("key"), _form_encoded(raw_value(p)).alias("value")))
    kept = F.filter(split, lambda s: ~(F.lower(s["name"]).startswith("utm_") | F.lower(s["name"]).isin(*TRACKING_KEYS)))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(s["key"], F.lit("="), s["value"])), "&")
    bad = F.exists(split, lambda s: s["name"].isNull() | s["value"].isNull() | F.contains(s["name"], F.lit("�")) | F.contains(F.try_url_decode(s["value"]), F.lit("�")))
    return F.when(~bad, joined)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, credentials or tracking keys; null if that is not possible."""
    clean = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(clean, SPLIT, i)
    scheme, netloc, path = F.lower(part(1)), part(2), part(3)
    host = canonical_host(F.regexp_extract(netloc, r"^(.*?)(?::([0-9]*))?$", 1))
    port = F.regexp_replace(F.regexp_extract(netloc, r":([0-9]*)$", 1), "^0+(?=[0-9])", "")
    usual = (port == "") | ((scheme == "http") & (port == DEFAULT_PORTS["http"])) | ((scheme == "https") & (port == DEFAULT_PORTS["https"]))
    query = canonical_query(part(4))
    good = (
        ~url.rlike(r"[\x00-\x1f]")
        & scheme.isin("http", "https")
        & ~has_malformed_escape(clean)
        & ~netloc.rlike(r"(?U)[@\\\s]")
        & netloc.rlike("^[^:]+(?::[0-9]*)?$")
        & ((port == "") | (port.try_cast("int") <= 65535))
    )
    built = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(good & host.isNotNull() & query.isNotNull(), built)


def _exact(raw: str | None) -> str | None:
    import ipaddress
    import re

    if raw is None or re.search(r"[\x00-\x1f]", raw) or re.search(MALFORMED_ESCAPE, raw.strip()):
        return None
    try:
        parts = urlsplit(raw.strip())
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
        if scheme not in DEFAULT_PORTS or re.search(r"[@\\\s]", parts.netloc):
            return None
        if ":" in host:
            host = f"[{ipaddress.IPv6Address(host) and host}]"
        elif not re.fullmatch(rf"(?a:(?:{LABEL}\.)*{LABEL})", host) or len(host) > 253:
            return None
        pairs = parse_qsl(parts.query, keep_blank_values=True, errors="strict")
    except ValueError:
        return None
    kept = [p for p in pairs if not p[0].lower().startswith("utm_") and p[0].lower() not in TRACKING_KEYS]
    at = host if port is None or str(port) == DEFAULT_PORTS[scheme] else f"{host}:{port}"
    return urlunsplit((scheme, at, parts.path or "/", urlencode(sorted(kept, key=lambda p: p[0])), ""))


@F.pandas_udf(T.StringType())
def canonical_url_exact(urls: pd.Series) -> pd.Series:
    """The same rules by an Arrow kernel, IPv6 hosts and undecodable escapes included."""
    return urls.map(lambda u: _exact(u) if isinstance(u, str) else None)


@F.pandas_udf(T.BinaryType())
def url_fingerprint(urls: pd.Series) -> pd.Series:
    """128-bit blake2b of a canonical URL."""
    from hashlib import blake2b

    return urls.map(lambda u: blake2b(u.encode(), digest_size=16).digest() if isinstance(u, str) else None)


def corpus_url(url: Column) -> Column:
    """Lower-cased, without query, fragment and trailing slashes: the key of a record's address. '' for null."""
    clean = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", ""))
    whole = clean.rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+")
    return F.when(whole, F.rtrim(F.regexp_replace(clean, "[?#].*$", ""), F.lit("/"))).otherwise(F.rtrim(clean, F.lit("/")))


def sitemap_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port or fragment; the query as it is; null unless HTTP(S) without credentials."""
    part = lambda i: F.regexp_extract(F.trim(url), SPLIT, i)
    scheme, netloc, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    short = F.regexp_replace(F.when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).otherwise(F.regexp_replace(netloc, ":443$", "")), ":$", "")
    return F.when(scheme.isin("http", "https") & (netloc != "") & ~F.contains(netloc, F.lit("@")), F.concat(scheme, F.lit("://"), short, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def origin(url: Column) -> Column:
    """scheme://authority of an HTTP(S) URL."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1), F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def reversed_host(host: Column) -> Column:
    """Labels from right to left, so that a domain's hosts share a prefix."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def resolve_root_relative(base: Column, href: Column) -> Column:
    """An absolute href as it is, a root-relative one on the base's origin."""
    return F.when(href.startswith("/") & ~href.startswith("//"), F.concat(origin(base), href)).when(href.rlike("(?i)^https?://"), href)


def in_domain(host: Column, domain: str) -> Column:
    """The domain itself or a host below it; on reversed names, so that it reaches a scan as a prefix."""
    back = ".".join(reversed(domain.lower().split(".")))
    return (reversed_host(host) == back) | reversed_host(host).startswith(back + ".")


def in_subdomain(host: Column, domain: str) -> Column:
    return reversed_host(host).startswith(".".join(reversed(domain.lower().split("."))) + ".")


def has_prefix(url: Column, prefix: str) -> Column:
    return url.startswith(prefix)


def is_official(url: Column) -> Column:
    """Whether the URL is a publisher's or official proceedings' record; preprints are not."""
    host = F.coalesce(host_of(corpus_url(url)), F.lit(""))
    below = F.exists(F.array(*[F.lit("." + h) for h in OFFICIAL_HOSTS if h != "doi.org"]), lambda h: F.endswith(host, h))
    return ~((host == "arxiv.org") | host.endswith(".arxiv.org")) & (host.isin(*OFFICIAL_HOSTS) | below)


def is_reviewed_fulltext(url: Column) -> Column:
    host = F.coalesce(host_of(corpus_url(url)), F.lit(""))
    return is_official(url) | (host == "arxiv.org") | host.endswith(".arxiv.org")


def page_rank(url: Column) -> Column:
    """The order in which a sitemap's children are visited: products, collections, pages, others."""
    return F.when(F.lower(url).rlike("product"), 0).when(F.lower(url).rlike("collection"), 1).when(F.lower(url).rlike("page"), 2).otherwise(3)


def unique_numeric_parameter(url: Column, name: str = "id") -> Column:
    """The digits of a query parameter that occurs exactly once, else null."""
    pairs = F.filter(F.split(F.regexp_extract(url, SPLIT, 4), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.substring_index(F.get(pairs, F.lit(0)), "=", -1)
    return F.when((F.size(pairs) == 1) & value.rlike("^[0-9]+$"), value)


def public_host(url) -> bool:
    """HTTP(S) with a public host: no local name, no private, loopback or reserved address."""
    import ipaddress

    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".").encode("idna").decode().lower()
        if parts.scheme not in DEFAULT_PORTS or parts.username or not (parts.port or 1) or not host or host == "localhost" or host.endswith((".localhost", ".local")):
            return False
    except (ValueError, UnicodeError, AttributeError, TypeError):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host


@F.pandas_udf(T.BooleanType())
def is_public_url(urls: pd.Series) -> pd.Series:
    """public_host() of each."""
    return urls.map(public_host)


@F.pandas_udf(T.BooleanType())
def are_public_urls(lists: pd.Series) -> pd.Series:
    """Whether a list holds public URLs alone, and one at least; null for no list."""
    return lists.map(lambda urls: None if urls is None else bool(len(urls)) and all(map(public_host, urls)))
