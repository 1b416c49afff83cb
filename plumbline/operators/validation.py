"""Validators and acceptance rules: reading ledgers, relations, comments, identifiers, downloads, files, reports and promotions.

Each gives rows or messages that say what is wrong; nothing wrong is an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import sequence_ratio, squeezed, title_key, token_overlap
from plumbline.functions.urls import host_of
from plumbline.operators import scan
from plumbline.operators.digests import package_digests


def _messages(*pairs: tuple[Column, Column | str]) -> Column:
    """The messages of the tests that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text if isinstance(text, Column) else F.lit(text)) for test, text in pairs]))


# What a reading ledger says of each page.
VISUAL_CHECKS = ("captions_checked", "equations_checked", "figures_checked", "tables_checked")


def ledger_faults(pages: DataFrame, expected: int) -> DataFrame:
    """page and fault of a reading ledger: pages that are missing, repeated, unread, unchecked or unresolved; unaudited figures.

    pages: page, text_read, the visual checks, unresolved (array) and figure_audits (array).
    """
    spark = pages.sparkSession
    wanted = spark.range(1, expected + 1).select(F.col("id").cast("int").alias("page"))
    counts = pages.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    missing = wanted.join(counts, "page", "left_anti").select("page", F.lit("page is missing").alias("fault"))
    extra = counts.where((F.col("n") > 1) | ~F.col("page").between(1, expected)).select("page", F.lit("page is repeated or unknown").alias("fault"))
    checks = [(~F.coalesce(F.col(c), F.lit("")).isin("checked", "not_present"), f"{c} must be checked or not_present") for c in VISUAL_CHECKS if c in pages.columns]
    figures = F.col("figures_checked") == "checked"
    none = F.coalesce(F.size("figure_audits"), F.lit(0)) <= 0
    own = pages.select("page", F.explode(_messages((~F.coalesce(F.col("text_read"), F.lit(False)), "text_read is not true"), *checks, (F.size("unresolved") > 0, F.concat(F.lit("unresolved: "), F.array_join("unresolved", ", "))), (figures & none, "checked figures require audits"), (figures & (F.col("captions_checked") != "checked"), "figures require checked captions"), (~figures & ~none, "audits without figures"))).alias("fault"))
    return missing.unionByName(extra).unionByName(own)


def relation_faults(items: DataFrame) -> DataFrame:
    """group_id and fault: a group needs a predicate, an entity, effect or condition, and one type. items: group_id, role, type."""
    groups = items.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.collect_set("role").alias("roles"), F.countDistinct("type").alias("types"))
    faults = _messages((~F.array_contains("roles", "predicate"), "requires at least one predicate"), (~F.arrays_overlap("roles", F.array(*map(F.lit, ("entity", "effect", "condition")))), "requires at least one entity, effect, or condition"), (F.col("types") != 1, "inconsistent types"))
    return groups.select("group_id", F.explode(faults).alias("fault"))


# How lines of a comment start.
CONCLUSIONS = ("结论：", "外部信息：")
ANALYSES = ("机制：", "意义：", "复现：", "边界：", "疑点：", "位置：", "来源：")


def comment_faults(comment: Column) -> Column:
    """What a comment lacks: a conclusion first, and an analysis after it."""
    lines = F.filter(F.transform(F.split(F.coalesce(comment, F.lit("")), "\r?\n"), squeezed), lambda line: line != "")
    starts = lambda line, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.startswith(line, m))
    first, rest = F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) == 0, F.array(F.lit("comment is empty"))).otherwise(_messages((~starts(first, CONCLUSIONS), "first line is no conclusion"), (F.size(lines) < 2, "no analysis after the conclusion"), ((F.size(lines) >= 2) & ~F.exists(rest, lambda line: starts(line, ANALYSES)), "no labelled analysis")))


def pdf_rect(rect: Column, box: Column) -> Column:
    """A rectangle from the top-left system of a page into the bottom-left one of its box."""
    low, high = F.get(box, F.lit(1)), F.get(box, F.lit(3))
    at = lambda i: F.get(rect, F.lit(i))
    return F.transform(F.array(at(0), low + high - at(3), at(2), low + high - at(1)), lambda x: F.round(x, 6))


def sort_index(page: Column, top: Column, n: Column) -> Column:
    return F.format_string("%05d|%06d|%05d", page.cast("int"), top.cast("int"), n.cast("int"))


def accept_doi(pairs: DataFrame) -> DataFrame:
    """pairs with accepted: titles alike, and enough of author, venue and year agree. Columns: title, author, venue, year of c_ and t_ (candidate, target)."""
    key = lambda c: title_key(F.coalesce(F.col(c), F.lit("")))
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    author, wanted = low("c_author"), low("t_author")
    both = (author != "") & (wanted != "")
    agree = F.contains(wanted, author) | F.contains(author, wanted)
    votes = both.cast("int") + ((low("c_venue") != "") & F.contains(low("t_venue"), low("c_venue"))).cast("int") + ((low("c_year") != "") & (low("c_year") == low("t_year"))).cast("int")
    scored = pairs.withColumn("title_ratio", sequence_ratio(key("c_title"), key("t_title")))
    good = (key("c_title") != "") & (key("t_title") != "") & (F.col("title_ratio") >= 0.92) & ~(both & ~agree) & (votes >= F.when(wanted == "", 1).otherwise(2))
    return scored.withColumn("accepted", good)


def title_matches(target: Column, found: Column) -> Column:
    """Whether the words of a title are those of a file: 0.55 of them, or the sorted words look alike."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), 0)))
    a, b = words(target), words(found)
    return (F.size(a) > 0) & (F.size(b) > 0) & ((token_overlap(a, b) >= 0.55) | (sequence_ratio(F.array_join(a, ""), F.array_join(b, "")) >= 0.72))


def is_pdf(content: Column) -> Column:
    """Whether bytes are a PDF of some size and no web page."""
    head = F.lower(F.ltrim(F.substring(content, 1, 128).cast("string")))
    return (F.octet_length(content) >= 256) & (F.hex(F.substring(content, 1, 5)) == "255044462D") & ~head.startswith("<!doctype") & ~head.startswith("<html")


def pdf_addresses(paper: DataFrame) -> DataFrame:
    """paper with candidates: addresses that its source suggests, in order, none of a preprint server. Columns: formal_pdf_url, source_url, url."""
    s = F.coalesce(F.col("source_url"), F.lit(""))
    ieee = F.regexp_extract(s, r"ieeexplore\.ieee\.org/document/([0-9]+)", 1)
    made = F.array_compact(
        F.array(
            F.nullif(F.col("formal_pdf_url"), F.lit("")),
            F.when(F.lower(s).endswith(".pdf") | F.contains(F.lower(s), F.lit("/pdf")), s),
            F.when(s.rlike(r"(proceedings\.mlr\.press|roboticsproceedings\.org).*\.html$"), F.regexp_replace(s, r"\.html$", ".pdf")),
            F.when(ieee != "", F.concat(F.lit("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber="), ieee, F.lit("&ref="))),
            F.when(F.contains(s, F.lit("nature.com/articles/")), F.concat(F.rtrim(s, F.lit("/")), F.lit(".pdf"))),
            F.when(F.contains(s, F.lit("science.org/doi/")), F.replace(s, F.lit("/doi/"), F.lit("/doi/pdf/"))),
            F.when(F.lower("url").endswith(".pdf"), F.col("url")),
        )
    )
    allowed = lambda u: u.rlike("^https?://") & ~F.coalesce(host_of(u).rlike(r"(^|\.)arxiv\.org$"), F.lit(False))
    return paper.withColumn("candidates", F.filter(F.array_distinct(made), allowed))


def source_line(line: Column, key: Column, label: str = "PDF", prefix: str = "library://items/") -> Column:
    """A line with its library link set to an attachment; null keeps the line."""
    link = F.concat(F.lit(f"[{label}]({prefix}"), key, F.lit(")"))
    known = rf"\[{re.escape(label)}\]\({re.escape(prefix)}[^)]+\)"
    new = F.when(line.rlike(known), F.regexp_replace(line, F.lit(known), link)).when(F.contains(line, F.lit(" ^paper-")), F.regexp_replace(line, F.lit(r" \^paper-"), F.concat(F.lit(", "), link, F.lit(" ^paper-")))).otherwise(F.concat(F.rtrim(line), F.lit(", "), link))
    return F.coalesce(new, line)


def bulk_readiness() -> Column:
    """What a backend can do. Columns: source_kind, scope_mode, valid_sitemaps, primary_urls, raw_rate, exhaustive_seeds."""
    some = F.col("primary_urls") > 0
    return F.when((F.col("source_kind") == "search") | (F.col("valid_sitemaps") == 0), "bulk_unavailable").when(((F.col("scope_mode") == "site") & some) | (F.col("raw_rate") >= 50) | ((F.col("exhaustive_seeds") >= 2) & some), "bulk_ready").otherwise("bulk_degraded")


def product_evidence(url: Column, sitemap: Column, hints: list[str], hosts: list[str], shard_words: tuple[str, ...] = ("product", "products", "item", "items")) -> Column:
    """Why a URL may be a product's: its sitemap, its path, its host."""
    words = lambda u: F.split(F.lower(F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)), "[^a-z0-9]+")
    has = lambda u, names: F.arrays_overlap(words(u), F.array(*[F.lit(n.strip("/").lower()) for n in names] or [F.lit("\0")]))
    return _messages((has(sitemap, shard_words), "sitemap_product_shard"), (has(url, hints), "url_path_hint"), (host_of(url).isin(*[h.lower() for h in hosts]), "product_hostname"))


# What workspace folders and file endings mean.
AUTO_SUFFIXES, SOFT_PROTECTED, PROPOSALS = ("pyc", "pyo"), ("docs", "src", "tests"), ("draft", "drafts", "old", "backup", "tmp", "temp")


def workspace(files: DataFrame, protected: list[str], *, exact: list[str] = (), finished: list[str] = (), tests_done: bool = False) -> DataFrame:
    """path, size and class (auto, proposal, protected) of each file, by the first rule that holds. files: path, size."""
    parts = F.transform(F.split("path", "/"), F.lower)
    among = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n.lower()) for n in names] or [F.lit("\0")]))
    suffix = F.lower(F.substring_index(F.substring_index("path", "/", -1), ".", -1))
    kind = F.when(among(protected), "protected").when(among(["__pycache__"]) | suffix.isin(*AUTO_SUFFIXES), "auto").when(among([".pytest_cache"]), "auto" if tests_done else "protected").when(F.col("path").isin(*finished), "auto").when(among(SOFT_PROTECTED), "protected").when(F.col("path").isin(*exact) | among(PROPOSALS), "proposal").otherwise("protected")
    return files.select("path", "size", kind.alias("class"))


def working_artifact(path: Column, folders: tuple[str, ...] = (".agents", ".cache", "tmp")) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*folders))


def is_due(last: Column, now: Column, interval: Column) -> Column:
    """Whether an interval has passed; a clock that runs backwards stops the query."""
    return F.when(last.isNull(), True).when(now < last, F.raise_error(F.lit("the clock runs backwards")).cast("boolean")).otherwise(now - last >= interval)


def gates_to_run(gates: DataFrame, cache: DataFrame) -> DataFrame:
    """Gates (gate, fingerprint, final, affected) that must run again: final or affected ones, and those without a passed result of the same inputs."""
    held = cache.where("passed").select("gate", F.col("fingerprint").alias("__fp"))
    joined = gates.join(held, "gate", "left")
    return joined.where(F.col("final") | F.col("affected") | ~F.coalesce(F.col("fingerprint") == F.col("__fp"), F.lit(False))).drop("__fp")


def keep_collecting(items: Column, stable: Column, elapsed_ms: Column, most: Column, quiet: int = 3, limit_ms: int = 30_000) -> Column:
    return (items < most) & (stable < quiet) & (elapsed_ms < limit_ms)


def unsupported_claims(sources: DataFrame, checks: DataFrame) -> DataFrame:
    """Sources (claim, url) whose URL no good check (requested, final, ok) covers, by what was asked or where it led."""
    good = checks.where("ok").select(F.explode(F.array_distinct(F.array("requested", "final"))).alias("url")).distinct()
    return sources.join(good, "url", "left_anti")


# Stop reasons that a run type allows.
STOPS = {"saturation": ("search_saturated", "ten_minute_limit"), "catalog_enumeration": ("deterministic_scope_complete", "ten_minute_limit"), "bounded": ("deterministic_scope_complete", "ten_minute_limit", "search_saturated")}


def report_faults() -> Column:
    """What contradicts itself in a run's statistics. Columns: run_type, stop, seconds, candidates, average_rate, zero_gap, previous, new, invalid, cumulative, invalidations, sources."""
    types = F.create_map(*[x for k, v in STOPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.try_element_at(types, F.col("run_type"))
    return _messages(
        (allowed.isNull(), "unknown run type"), (~F.array_contains(allowed, F.col("stop")), "stop does not fit the run type"), ((F.col("stop") == "ten_minute_limit") & (F.col("seconds") < 600), "stopped before the limit"),
        (F.abs(F.col("average_rate") - F.try_divide(F.col("candidates"), F.col("seconds"))) > 0.01, "rate does not fit"), ((F.col("stop") == "ten_minute_limit") & (F.col("zero_gap") >= 30), "a window without finds"),
        (F.col("cumulative") != F.col("previous") + F.col("new") - F.col("invalid"), "cumulative does not add up"), (F.col("invalidations") < F.col("invalid"), "invalidation without evidence"), (~F.exists("sources", lambda u: u.rlike("^https?://")), "no source"),
    )


def statistic(section: Column, name: str) -> Column:
    """The value of a line `- name: value` of a section; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(section, rf"(?m)^-[ \t]+{name}[:：][ \t]*(.*)$", 1)), F.lit(""))


def promotion(incidents: DataFrame) -> DataFrame:
    """eligible, stage and reasons of incidents with their route. Columns: status, expected_effect, regression_test, domain_semantics, reuse_failures, promotion, policy, auto_apply, canonical."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    full = F.col("domain_semantics") | (F.coalesce("policy", F.lit("full")) == "full")
    blocking = _messages((~F.col("status").isin("verified", "promoted"), "verified incident required"), (full & blank("expected_effect"), "effect contract required"), (full & blank("regression_test"), "regression test required"), (F.col("reuse_failures") > 0, "reuse regression must be resolved"), (~F.coalesce("promotion", F.lit("none")).isin("none", "eligible"), "already applied or rolled back"), (~F.col("canonical"), "canonical component missing"))
    owner = _messages((F.col("domain_semantics") | ~F.col("auto_apply"), "owner evidence contract required"))
    eligible = F.size(blocking) == 0
    stage = F.when(eligible & ~full, "ready-for-lightweight-permanent-fix").when(eligible, "ready-for-permanent-fix").otherwise("temporary")
    return incidents.select("*", eligible.alias("eligible"), stage.alias("stage"), F.concat(blocking, owner).alias("reasons"), (eligible & F.col("auto_apply") & ~F.col("domain_semantics")).alias("allow_auto_apply"))


def requirement_states(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """id and state: verified with current evidence of each kind it needs, partial with some, else pending. evidence: requirement, kind, stale."""
    kinds = evidence.where("not stale").groupBy(F.col("requirement").alias("id")).agg(F.collect_set("kind").alias("kinds"))
    open_ = F.array_except("needs", F.coalesce("kinds", F.array().cast("array<string>")))
    return requirements.join(kinds, "id", "left").select("id", F.when(F.size(open_) == 0, "verified").when(F.size("kinds") > 0, "partial").otherwise("pending").alias("state"))


def gate_states(gates: DataFrame, states: DataFrame) -> DataFrame:
    """gate and whether all its requirements are verified. gates: gate, requirement."""
    return gates.join(states.select(F.col("id").alias("requirement"), "state"), "requirement", "left").groupBy("gate").agg(F.bool_and(F.coalesce(F.col("state") == "verified", F.lit(False))).alias("verified"))


def image_faults(index: DataFrame, files: DataFrame, batch: int = 5) -> DataFrame:
    """logical_id and fault of an image index: numbers that do not go on, wrong batches, files that are gone or differ. Images follow their numbers, of whatever width."""
    n = F.regexp_extract("logical_id", "([0-9]+)$", 1).cast("int")
    numbered = scan.ranged(index.withColumns({"__n": n, "__all": F.lit(0)}), [], ["__n", "logical_id"])
    rows = scan.previous(numbered, ["__all"], ["__n", "logical_id"], {"__before": "__n"}).join(files.select("filename", F.col("sha256").alias("__sha")), "filename", "left")
    faults = _messages((F.col("__n") != F.coalesce(F.col("__before") + 1, F.lit(1)), "numbers do not go on"), (F.regexp_extract("batch_id", "([0-9]+)$", 1).cast("int") != F.ceil(F.col("__n") / batch), "wrong batch"), (F.col("position") != F.pmod(F.col("__n") - 1, F.lit(batch)) + 1, "wrong position"), (F.col("__sha").isNull(), "file is gone"), (F.col("__sha") != F.col("sha256"), "file differs"))
    return rows.select("logical_id", F.explode(faults).alias("fault"))


def generated_changes(desired: DataFrame, baseline: DataFrame) -> DataFrame:
    """name and change of generated files against the last run: new, changed, retired. Both: name, digest."""
    joined = desired.select("name", F.col("digest").alias("d")).join(baseline.select("name", F.col("digest").alias("b")), "name", "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("d").isNull(), "retired").when(F.col("b") != F.col("d"), "changed")
    return joined.select("name", change.alias("change")).where("change is not null")


def lock(files: DataFrame, components: DataFrame) -> DataFrame:
    """component, version and digest of each component's files. files: component, path, content."""
    return package_digests(files, "component").join(components, "component").select("component", "version", "digest")


def resources(cpus: int, free_mb: int, total_mb: int, *, broad: bool) -> dict[str, str]:
    """Spark settings from what a machine has: three quarters of it for broad queries, half for others, a quarter if memory is short."""
    share = 0.25 if free_mb < 0.2 * total_mb else 0.75 if broad else 0.5
    cores = max(1, int(cpus * share))
    return {"spark.sql.shuffle.partitions": str(2 * cores), "spark.sql.files.maxPartitionBytes": f"{max(16, int(free_mb * share / cores / 8))}m", "spark.driver.maxResultSize": f"{max(256, int(free_mb * 0.1))}m"}
