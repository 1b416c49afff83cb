"""Joins and set operators: overlays, three-way states, fallbacks, identity groups and passage matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import scan


def overlay(local: DataFrame, public: DataFrame, key: str) -> DataFrame:
    """All rows of both by key; where both have one, local values first and public ones for what is null."""
    right = public.select(*[F.col(c).alias(f"__{c}") for c in public.columns])
    joined = local.join(right, F.col(key) == F.col(f"__{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in local.columns])


def update_join(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the non-null values of changes of equal key."""
    fields = [c for c in changes.columns if c != key and c in base.columns]
    right = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return base.join(right, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def three_way(baseline: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """path and state of each path of three (path, digest) trees: equal, left-changed, right-changed or conflict."""
    named = [frame.select("path", F.col("digest").alias(name)) for frame, name in ((baseline, "base"), (left, "l"), (right, "r"))]
    joined = reduce(lambda a, b: a.join(b, "path", "full_outer"), named)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = F.when(same("l", "r"), "equal").when(same("base", "l"), "right-changed").when(same("base", "r"), "left-changed").otherwise("conflict")
    return joined.select("path", state.alias("state"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ, and how: added, removed, changed."""
    whole = lambda frame, name: frame.select(key, F.struct(*sorted(c for c in frame.columns if c != key)).alias(name))
    joined = whole(before, "b").join(whole(after, "a"), key, "full_outer").where(~F.col("b").eqNullSafe(F.col("a")))
    return joined.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))


def duplicate_groups(rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    """key and sorted ids of each key that several rows have; keys is an array, so one shuffle serves all kinds of keys."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(keys_col)).alias("key"))
    repeated = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return each.join(repeated, "key").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def match_any(left: DataFrame, right: DataFrame, left_keys: str, right_keys: str, left_id: str, right_id: str) -> DataFrame:
    """(left id, right id) pairs that share any key of two arrays: an OR of equalities as one equi-join."""
    a = left.select(F.col(left_id).alias("left_id"), F.explode(F.array_distinct(left_keys)).alias("key"))
    b = right.select(F.col(right_id).alias("right_id"), F.explode(F.array_distinct(right_keys)).alias("key"))
    return a.join(b, "key").select("left_id", "right_id").distinct()


def classify_after_write(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """Matches after a write: each id, whether it is new, and the outcome over all: unique, duplicate or review."""
    marked = after.join(before.select(F.col(id_col).alias("__id")).distinct(), F.col(id_col) == F.col("__id"), "left")
    new = marked.select(id_col, F.col("__id").isNull().alias("is_new"))
    totals = new.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_new"), 1)).alias("created"))
    outcome = F.when(F.col("n") == 1, "unique").when(F.col("created") == 1, "duplicate").otherwise("review")
    return new.join(F.broadcast(totals.select(outcome.alias("outcome"))))


#: Lengths of the starts of strings that are looked for; 0 is for empty ones, which every text holds.
STARTS = (0, 1, 2, 4, 8)


def holding(rows: DataFrame, strings: DataFrame, row_id: str, text: str, string_id: str, string: str) -> DataFrame:
    """row and string ids where a row's text holds a string, any number of strings: no row meets every string.

    A string's start, as long as STARTS has it, meets the pieces of that length of the texts; what meets is confirmed.
    """
    size = F.greatest(*[F.when(F.length(string) >= n, n).otherwise(0) for n in STARTS[1:]], F.lit(0))
    wanted = strings.where(F.col(string).isNotNull()).select(string_id, string, size.alias("size")).withColumn("start", F.substring(F.col(string), F.lit(1), F.col("size")))
    used = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    chars = rows.where(F.col(text).isNotNull()).select(row_id, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("chars"))
    count = F.size("chars")
    cut = lambda n: F.transform(F.when(count >= n, F.sequence(F.lit(1), count - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("chars", i, F.lit(n)), ""))
    pieces = F.flatten(F.array(F.array().cast("array<string>"), *[cut(n) if n else F.array(F.lit("")) for n in used]))
    near = chars.select(row_id, F.explode(F.array_distinct(pieces)).alias("start")).join(wanted.select("start", string_id), "start").select(row_id, string_id).distinct()
    whole = near.join(rows.select(row_id, text), row_id).join(wanted.select(string_id, string), string_id)
    return whole.where(F.contains(F.col(text), F.col(string))).select(row_id, string_id)


def contained_passages(docs: DataFrame, passages: DataFrame, few: int = 100) -> DataFrame:
    """doc_id and item_id where a document holds a passage's text, by hashed words: no document meets every passage.

    Three words inside a passage, spaces around them, stand whole in any text that holds it: their hash meets those of the
    documents' word triples, and what meets is confirmed on the texts. Up to `few` passages of fewer words are
    looked for in a broadcast; more of them meet the texts by the characters they start with.
    """
    triple = lambda words, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    items = passages.select("item_id", F.col("text").alias("passage"), F.split("text", " ").alias("words"))
    long = items.where(F.size("words") >= 5).select("item_id", "passage", triple(F.col("words"), F.lit(1)).alias("h"))
    words = docs.select("doc_id", F.split("text", " ").alias("words")).where(F.size("words") >= 5)
    windows = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: triple(F.col("words"), i)))).alias("h"))
    near = windows.join(long.select("h", "item_id"), "h").select("doc_id", "item_id").distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").join(long.select("item_id", "passage"), "item_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    short = items.where(F.size("words") < 5).select("item_id", "passage")
    if short.limit(1).count() == 0:
        return found
    if short.limit(few + 1).count() <= few:
        return found.unionByName(docs.join(F.broadcast(short), F.contains("text", F.col("passage"))).select("doc_id", "item_id"))
    return found.unionByName(holding(docs, short, "doc_id", "text", "item_id", "passage"))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each set operation gives."""
    named = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    return reduce(DataFrame.unionByName, [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("operation"), "n") for name, f in named.items()])


def concatenated(*tables: DataFrame, order: str = "ord") -> DataFrame:
    """The rows of all tables, one table after the other and each in its order, numbered anew from 1 in the order column."""
    marked = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    placed = scan.numbered(reduce(DataFrame.unionByName, marked), ["__table", order], "__place")
    return placed.withColumn(order, F.col("__place")).select(*tables[0].columns)


def route_owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, owner, prefix and fault of each path: the owner of the longest rule (prefix, owner) that the path lies under.

    A path lies under a prefix that it equals or that ends at one of its slashes. Two owners of the longest prefix are
    ambiguous; no rule is unknown. A path is cut at its slashes, and the cuts meet the rules on equality.
    """
    parts = F.split("path", "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = paths.select("path").distinct().select("path", F.explode(cuts).alias("prefix")).join(rules.select(F.regexp_replace("prefix", "/+$", "").alias("prefix"), "owner").distinct(), "prefix")
    by = met.groupBy("path", "prefix").agg(F.count(F.lit(1)).alias("owners"), F.min("owner").alias("owner"))
    best = by.groupBy("path").agg(F.max_by(F.struct("prefix", "owners", "owner"), F.length("prefix")).alias("b")).select("path", "b.*")
    told = paths.join(best, "path", "left")
    fault = F.when(F.col("owners").isNull(), "unknown").when(F.col("owners") > 1, "ambiguous")
    return told.select("path", F.when(F.col("owners") == 1, F.col("owner")).alias("owner"), "prefix", fault.alias("fault"))


def without(files: DataFrame, *others: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key none of the others has: a chain of anti-joins on one key, so one shuffle a side."""
    return reduce(lambda left, right: left.join(right.select(key), key, "left_anti"), others, files)


def unexpected(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Paths that are there now, were not before and are not allowed; backslashes count as slashes."""
    plain = lambda frame: frame.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))
    return plain(after).subtract(plain(before)).subtract(plain(allowed))


def resolve_by_priority(left: DataFrame, key: str, *stages: tuple[Column, DataFrame, str]) -> DataFrame:
    """left with `resolved` and `stage`: the first of several lookups that has a value. A stage: (key expression, lookup (key, value), name)."""
    out, found, name = left, F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (expression, lookup, stage) in enumerate(stages):
        out = out.join(lookup.select(F.col("key").alias(f"__k{n}"), F.col("value").alias(f"__v{n}")), expression == F.col(f"__k{n}"), "left")
    for n, (_, _, stage) in reversed(list(enumerate(stages))):
        value = F.col(f"__v{n}")
        found, name = F.coalesce(value, found), F.when(value.isNotNull(), F.lit(stage)).otherwise(name)
    return out.select(*left.columns, found.alias("resolved"), name.alias("stage"))


def longest_prefix(rows: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """rows with the value of the first rule (prefix, value, ord) that their name starts with; null if none does.

    Prefixes of a name are its own cuts: each distinct name's are exploded and meet the rules on equality. Names that have a
    rule go back to the rows by a sorted join: there may be as many as rows, too many for the driver.
    """
    names = rows.select(F.col(name).alias("__name")).distinct()
    cuts = names.select("__name", F.explode(F.transform(F.sequence(F.lit(1), F.length("__name")), lambda n: F.substring(F.col("__name"), F.lit(1), n))).alias("prefix"))
    best = cuts.join(rules, "prefix").groupBy("__name").agg(F.min_by("value", "ord").alias("value"))
    return rows.join(best.hint("merge"), F.col(name) == F.col("__name"), "left").drop("__name")


def occurrences(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """page, quote and first token of each place where a quote's tokens stand in a page. pages: page, tokens; quotes: quote, tokens.

    Where quotes also have `before` and `after` (tokens), these must stand right beside the place; null or none asks nothing.
    Postings (token, page, place) meet each quote by its rarest token, so a frequent word is met only by quotes of such words
    alone; what meets is checked against the page's tokens, moved once.
    """
    none = F.array().cast("array<string>")
    side = lambda c: F.coalesce(c, none) if c in quotes.columns else none
    asked = quotes.where(F.size("tokens") > 0).select("quote", F.col("tokens").alias("wanted"), side("before").alias("before"), side("after").alias("after"))
    tokens = asked.select(F.explode("wanted").alias("token")).distinct()
    postings = pages.select("page", F.posexplode("tokens").alias("place", "token")).join(tokens, "token", "left_semi")
    counts = tokens.join(postings.groupBy("token").agg(F.count(F.lit(1)).alias("found")), "token", "left").na.fill(0, ["found"])
    each = asked.select("quote", F.posexplode("wanted").alias("offset", "token")).join(counts, "token")
    rarest = each.groupBy("quote").agg(F.min_by(F.struct("token", "offset"), F.struct("found", "offset")).alias("by")).select("quote", "by.*")
    starts = postings.join(rarest, "token").select("page", "quote", (F.col("place") - F.col("offset")).alias("place")).where("place >= 0")
    near = starts.join(pages.select("page", F.col("tokens").alias("all")), "page").join(asked, "quote")
    reads = lambda at, tokens: F.slice("all", at, F.size(tokens)) == F.col(tokens)
    room = F.col("place") >= F.size("before")
    held = reads(F.col("place") + 1, "wanted") & room & reads(F.when(room, F.col("place") - F.size("before") + 1).otherwise(1), "before") & reads(F.col("place") + 1 + F.size("wanted"), "after")
    return near.where(held).select("page", "quote", "place")


def aligned(records: DataFrame, parents: DataFrame, attachments: DataFrame) -> DataFrame:
    """Which library item each record is: number, parent, stage, candidates (of the stage), children, claimed (by how many records) and missing.

    Three equi-joins give candidates, the first that has one decides: the attachment that the record links to, the DOI, the
    title. Items are counted by key before they meet records, so that a frequent title is one row; joins are by sorting, as
    their sides may be as long as the records. number is a record's own. missing: fields that the parent lacks. records: number, doi, title_key, link_key; parents: key, doi, title_key, creators,
    date, venue, url; attachments: key, parent.
    """
    owner = attachments.where("parent is not null").select(F.col("key").alias("link_key"), "parent").join(parents.select(F.col("key").alias("parent")).hint("merge"), "parent")
    keyed = parents.withColumnRenamed("key", "parent")

    def counted(items: DataFrame, key: str, at: int) -> DataFrame:
        """The least item of each record by a key, and how many items have that key."""
        by_key = items.where(f"{key} != ''").select(key, "parent").distinct().groupBy(key).agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("candidates"))
        return records.where(f"{key} != ''").join(by_key.hint("merge"), key).select("number", "parent", "candidates", F.lit(at).alias("at"))

    by_stage = counted(owner, "link_key", 1).unionByName(counted(keyed, "doi", 2)).unionByName(counted(keyed, "title_key", 3))
    best = by_stage.groupBy("number").agg(F.min_by(F.struct("parent", "candidates", "at"), "at").alias("b")).select("number", "b.*")
    claims = best.groupBy("parent").agg(F.count(F.lit(1)).alias("claimed"))
    children = attachments.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    lacks = lambda c, test: F.when(test, F.lit(c))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fields = parents.select(F.col("key").alias("parent"), F.array_compact(F.array(lacks("doi", blank("doi")), lacks("creators", F.coalesce("creators", F.lit(0)) == 0), lacks("date", blank("date")), lacks("venue", blank("venue")), lacks("url", blank("url")))).alias("missing"))
    told = best.join(claims.hint("merge"), "parent").join(children.hint("merge"), "parent", "left").join(fields.hint("merge"), "parent")
    stage = F.when(F.col("at") == 1, "link").when(F.col("at") == 2, "doi").when(F.col("at") == 3, "title")
    none = F.lit(0).cast("long")
    return records.select("number").join(told.hint("merge"), "number", "left").select("number", "parent", stage.alias("stage"), F.coalesce("candidates", none).alias("candidates"), F.coalesce("children", none).alias("children"), F.coalesce("claimed", none).alias("claimed"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
