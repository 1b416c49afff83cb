"""Rules for annotations: what an annotation of a paper lacks to carry information.

An item has id, page, annotation_type (highlight, area), kind, color, note_question, claim, reason, information_roles (array),
evidence, confidence; by its mode also quote, context_summary, annotation_comment, metric_context, condition, link_context,
author_context, external_evidence, external_sources (array), verified_at, visual_object, rect (array); and
annotation_schema_version, relation (whether it has any field of a relation). Missing columns are null columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import folded, word_like_count
from plumbline.functions.urls import are_public_urls, is_public_url
from plumbline.operators.validation import comment_faults

# Required fields, roles, modes and what each of them asks, fragments and prefixes.
REQUIRED = ("annotation_type", "claim", "color", "confidence", "evidence", "id", "information_roles", "kind", "note_question", "page", "reason")
ROLES = (
    "problem", "motivation", "cause", "method", "mechanism", "design_rationale", "definition", "assumption", "condition", "effect", "metric", "comparison", "result", "limitation", "failure",
    "reuse", "evidence_gap", "reproducibility", "author_context", "contribution", "interface", "implementation", "training_scale", "experiment_setting", "baseline", "reference_role", "support_link",
)
MODES = ("semantic-span", "key-term", "key-metric", "key-link", "author-name")
MODE_TEXTS = {
    "key-term": ("context_summary", "annotation_comment"),
    "key-metric": ("metric_context", "condition", "annotation_comment"),
    "key-link": ("link_context", "annotation_comment"),
    "author-name": ("author_context", "external_evidence", "verified_at", "annotation_comment"),
}
FRAGMENTS = ("we propose", "our approach", "formal safety guarantees", "success rate remains", "moving obstacles", "forward invariance", "trained in isaac lab")
METHOD_NEEDS = ("mechanism", "design_rationale", "condition", "result", "definition", "interface", "implementation")
AREA_NEEDS = ("metric", "comparison", "result", "mechanism", "failure", "implementation")
METRIC_WORDS = r"(?i)\b(?:average|maximum|minimum|time|rate|latency|frequency|success|computation|trigger|velocity|distance|trials?|images?|depth)\b"
AUTHOR_PREFIX, OLD_AUTHOR_PREFIX = "外部信息：", "外部核验，不是论文正文事实："
LEAST_WORDS = 6

TEXTS = sorted({"quote", "visual_object", "selection_mode", *(f for fields in MODE_TEXTS.values() for f in fields)})
ARRAYS = ("external_sources", "rect")


def information_faults(items: DataFrame, key: str = "id") -> DataFrame:
    """key and faults of each item, in order of the rules; an item that lacks required fields tells of these alone."""
    missing = {c: F.lit(None).cast("string") for c in (*REQUIRED, *TEXTS) if c not in items.columns}
    missing |= {c: F.lit(None).cast("array<string>") for c in ARRAYS if c not in items.columns}
    missing |= {c: v for c, v in (("annotation_schema_version", F.lit(1)), ("relation", F.lit(False))) if c not in items.columns}
    rows = items.withColumns(missing) if missing else items
    return rows.select(F.col(key).alias(key), _faults(dict(rows.dtypes)).alias("faults"))


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def _faults(kinds: dict[str, str]) -> Column:
    absent = lambda c: F.coalesce(F.size(c) == 0, F.lit(True)) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    lacking = F.array_compact(F.array(*[F.when(absent(c), F.lit(c)) for c in REQUIRED]))
    roles = F.coalesce("information_roles", F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
    mode = F.when(_blank("selection_mode"), "semantic-span").otherwise(F.col("selection_mode"))
    highlight, span = F.col("annotation_type") == "highlight", mode == "semantic-span"
    version = F.coalesce(F.col("annotation_schema_version").try_cast("int"), F.lit(1))
    quote, comment = F.trim(F.coalesce("quote", F.lit(""))), F.trim(F.coalesce("annotation_comment", F.lit("")))
    words = lambda c: word_like_count(F.coalesce(F.col(c).cast("string"), F.lit("")))
    strange = F.array_sort(F.array_except(roles, F.array(*map(F.lit, ROLES))))
    when = lambda test, text: F.array_compact(F.array(F.when(F.coalesce(test, F.lit(False)), text if isinstance(text, Column) else F.lit(text))))

    def of(name: str, test: Column, text: str) -> Column:
        return when(highlight & (mode == name) & test, text)

    day = F.col("verified_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.col("verified_at").try_cast("date").isNotNull()
    prefix = F.when(version >= 3, AUTHOR_PREFIX).otherwise(OLD_AUTHOR_PREFIX)
    area, plain = F.col("annotation_type") == "area", highlight & span
    rules = [
        when(F.col("annotation_schema_version").try_cast("int").isNull() | (version < 1), "schema version is no positive number"),
        when(F.size(strange) > 0, F.concat(F.lit("unknown roles: "), F.array_join(strange, ", "))),
        when(~mode.isin(*MODES), "unknown selection mode"),
        when(~highlight & ~span, "mode needs a highlight"),
        *[when(plain & _blank(c), f"span lacks {c}") for c in ("quote", "claim", "reason")],
        *[of(m, quote == "", f"{m} lacks quote") for m in MODES[1:]],
        of("key-term", words("quote") < 1, "key-term has no word"),
        of("key-metric", ~quote.rlike(r"(?U)\d"), "key-metric has no number"),
        of("key-link", (quote == "") | ~is_public_url("quote"), "key-link is no public address"),
        of("author-name", F.col("kind") != "author-background", "author-name of another kind"),
        of("author-name", ~has(["author_context"]), "author-name lacks its role"),
        *[of(m, _blank(c), f"{m} lacks {c}") for m, fields in MODE_TEXTS.items() for c in fields],
        of("key-link", ~has(["support_link"]), "key-link lacks its role"),
        of("author-name", ~_blank("external_evidence") & ~is_public_url("external_evidence"), "author-name evidence is no public address"),
        of("author-name", ~are_public_urls("external_sources"), "author-name sources are no public addresses"),
        of("author-name", ~_blank("verified_at") & ~F.coalesce(day, F.lit(False)), "author-name date is no date"),
        of("author-name", (comment != "") & ~F.startswith(comment, prefix), "author-name comment lacks its prefix"),
        when(plain & folded(quote).isin(*FRAGMENTS), "quote is a fragment"),
        when(plain & quote.rlike(r"(?U)^[\d\s.,%μ-]+$") & ~quote.rlike(METRIC_WORDS), "number without context"),
        when(plain & (words("quote") < LEAST_WORDS) & ~F.coalesce("relation", F.lit(False)), "quote is too short"),
        when(plain & has(["method"]) & ~has(METHOD_NEEDS), "method without mechanism or result"),
        when(area & span & _blank("visual_object"), "area lacks visual_object"),
        when(area & span & ~F.coalesce(F.size("rect") == 4, F.lit(False)), "area lacks its rectangle"),
        when(area & span & ~has(AREA_NEEDS), "area lacks a role of evidence"),
        when(~highlight & ~area, "unknown annotation type"),
        when(words("claim") < LEAST_WORDS, "claim explains nothing"),
        when(words("reason") < LEAST_WORDS, "reason justifies nothing"),
        F.when(version >= 3, comment_faults(F.col("annotation_comment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(F.size(lacking) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))).otherwise(F.concat(*rules))
