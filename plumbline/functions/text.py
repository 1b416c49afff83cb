"""Text expressions: titles, identifiers, venues, counts and normal forms. Missing text is '' in and out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Venue names in the order in which they are looked for.
VENUES = (
    "Science Robotics", "Nature Machine Intelligence", "NeurIPS", "Nature", "Science", "TPAMI", "TNNLS", "TMech", "TASE",
    "TITS", "IJRR", "ICRA", "IROS", "CoRL", "CVPR", "ICCV", "ICML", "ICLR", "AAAI", "RSS", "RAL", "TRO", "arXiv",
)
# Venues that a clean corpus takes.
WHITELIST = (
    "Nature", "Science", "Science Robotics", "NMI", "TPAMI", "TRO", "RAL", "TNNLS", "TMech", "TASE", "TITS", "IJRR",
    "ICRA", "IROS", "CoRL", "CVPR", "ICCV", "NeurIPS", "ICML", "ICLR", "AAAI", "RSS",
)
# Other spellings of venues.
VENUE_ALIASES = {
    "nature machine intelligence": "NMI", "tmech": "TMech", "t-mech": "TMech", "ral": "RAL", "tro": "TRO", "tase": "TASE",
    "tits": "TITS", "ijrr": "IJRR", "nips": "NeurIPS", "neurips": "NeurIPS",
}
# Fixed value: the same as lower-case names.
EXCLUDED_VENUES = ("arxiv", "mdpi", "ieee access", "frontiers", "tai", "tcst")


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def title_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and common CJK, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z一-鿿]+", " "))


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(unescaped(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def identity_title(text: Column) -> Column:
    """The key of a title without a trailing parenthesis: word characters of any script."""
    return F.regexp_replace(F.lower(without_parenthesis(unescaped(F.coalesce(text, F.lit(""))))), r"(?U)[^\w]+|_", "")


def without_parenthesis(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s*[\(（][^\(\)（）]*[\)）]\s*$", ""))


#: Character references and what they stand for; the ampersand comes last, as it may begin another.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column, names: tuple[str, ...] = tuple(REFERENCES)) -> Column:
    """The five predefined character references, and the no-break space; or those named, in their order."""
    out = text
    for name in names:
        out = F.replace(out, F.lit(name), F.lit(REFERENCES[name]))
    return out


def doi(text: Column) -> Column:
    """The first DOI, lower-cased, without closing punctuation; '' if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+", 0), F.lit(".,;:)]}>"))


def identifier(text: Column) -> Column:
    """doi:... or else arxiv:..., null if the text names neither."""
    low = F.lower(stripped(text))
    found = F.rtrim(F.regexp_extract(low, r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+", 0), F.lit(".,;"))
    preprint = F.regexp_extract(low, r"(?:arxiv\.org/(?:abs|pdf)/|arxiv:)\s*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)", 1)
    return F.when(found != "", F.concat(F.lit("doi:"), found)).when(preprint != "", F.concat(F.lit("arxiv:"), preprint))


def venue_in(meta: Column) -> Column:
    """The first venue of VENUES that the text names; '' if none."""
    low, out = F.lower(F.coalesce(meta, F.lit(""))), F.lit("")
    for name in reversed(VENUES):
        out = F.when(F.contains(low, F.lit(name.lower())), VENUE_ALIASES.get(name.lower(), name) if name == "Nature Machine Intelligence" else name).otherwise(out)
    return out


def canonical_venue(text: Column) -> Column:
    """The usual spelling of a venue; unknown names as they are."""
    raw = stripped(text)
    known = {name.lower(): name for name in WHITELIST} | VENUE_ALIASES
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(raw)), raw)


def year_in(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"20[0-9]{2}(?:-[0-9]{2})?", 0)


def first_integer(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\b[0-9]+\b", 0), F.lit("")), F.lit("0"))


def word_like_count(text: Column) -> Column:
    """Runs of Latin letters, digits and unit signs, and single CJK characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9μ×%]+|[一-鿿]"))


def folded(text: Column) -> Column:
    return F.lower(squeezed(text))


def heading_key(text: Column) -> Column:
    """A heading for comparison: no closing hashes or emphasis marks, single spaces, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+#+\s*$", ""), r"[*_`]", "")
    return F.lower(squeezed(bare))


def link_target(body: Column) -> Column:
    """target, anchor and alias of a link's body `target#anchor|alias`."""
    target = F.substring_index(body, "|", 1)
    return F.struct(
        stripped(F.substring_index(target, "#", 1)).alias("target"),
        F.when(F.contains(target, F.lit("#")), stripped(F.substring(target, F.length(F.substring_index(target, "#", 1)) + 2, F.length(target)))).alias("anchor"),
        F.when(F.contains(body, F.lit("|")), stripped(F.substring(body, F.length(target) + 2, F.length(body)))).alias("alias"),
    )


# File name endings of media.
MEDIA = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "pdf", "mp4", "webm")


def media_target(raw: Column) -> Column:
    """The path of a media reference: no title, anchor or query, unquoted, forward slashes; null if it is no local media file."""
    path = F.regexp_replace(F.regexp_replace(stripped(raw), "^<|>$", ""), r"""\s+["'].*["']$""", "")
    plain = F.replace(F.try_url_decode(F.replace(F.regexp_replace(path, "[#?|].*$", ""), F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    return F.when(~plain.rlike("^[a-z][a-z0-9+.-]*:") & F.lower(F.substring_index(plain, ".", -1)).isin(*MEDIA), F.regexp_replace(plain, r"^\./", ""))


def safe_detail(text: Column, most: int = 512) -> Column:
    """A failure's detail for a log: secrets gone, white space squeezed, cut."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(token|secret|password|authorization|cookie|api[_-]?key)\b\s*[:=]\s*\S+", "$1=[redacted]")
    return F.substring(squeezed(bare), 1, most)


def error_signature(text: Column) -> Column:
    """An error message with what changes from run to run replaced by placeholders."""
    out = F.coalesce(text, F.lit(""))
    # What changes between runs, in this order.
    for pattern, put in (
        (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
        (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\b", "<timestamp>"),
        (r"(?i)\bline\s+[0-9]+\b", "line <n>"),
        (r"(?i)\bpid[ =:]+[0-9]+\b", "pid <n>"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.lower(squeezed(out))


def authors(text: Column) -> Column:
    """first and last name of each author of a comma-separated list."""
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;，；]|\\band\\b"), stripped), lambda n: n != "")
    last = lambda n: F.substring_index(n, " ", -1)
    return F.transform(names, lambda n: F.struct(stripped(F.substring(n, F.lit(1), F.length(n) - F.length(last(n)))).alias("first"), last(n).alias("last")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_tokens(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded words without punctuation at their ends."""
    import unicodedata

    def tokens(text) -> list[str]:
        words = unicodedata.normalize("NFKC", text or "").casefold().split()
        bare = ("".join(c for c in w if c.isalnum()) for w in words)
        return [w for w in bare if w]

    return texts.map(tokens)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks, from 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def token_overlap(a: Column, b: Column) -> Column:
    """The share of a's tokens that b holds; 0 if a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)
