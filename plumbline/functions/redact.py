"""Redaction and audit of secrets, machine paths and e-mail addresses, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is looked for, in this order.
SECRETS = (
    r"\bgh[opsu]_[A-Za-z0-9]{20,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"""(?i)\b(?:api[_-]?key|access[_-]?token|password|secret)\b\s*[:=]\s*['"]?[A-Za-z0-9_./+\-=]{12,}""",
)
MACHINE_PATHS = (r"(?i)[A-Za-z]:\\Users\\[^\\\s]+", r"/home/[^/\s]+", r"/Users/[^/\s]+")
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
UNFINISHED = ("TODO", "TBD")

STEPS = (
    *(("possible_secret", p, "<REDACTED_SECRET>") for p in SECRETS),
    *(("machine_specific_path", p, "<USER_HOME>") for p in MACHINE_PATHS),
    ("personal_email", EMAIL, "<YOUR_EMAIL>"),
)


def redacted(text: Column, explicit: dict[str, str] | None = None) -> Column:
    """text with all finds replaced, and how many of each kind there were, as a struct."""
    out, counts = F.coalesce(text, F.lit("")), {}
    for kind, pattern, put in STEPS:
        found = F.regexp_count(out, F.lit(pattern))
        counts[kind] = counts[kind] + found if kind in counts else found
        out = F.regexp_replace(out, pattern, put)
    counts["explicit"] = F.lit(0)
    for find, put in (explicit or {}).items():
        counts["explicit"] += ((F.length(out) - F.length(F.replace(out, F.lit(find), F.lit("")))) / len(find)).cast("int")
        out = F.replace(out, F.lit(find), F.lit(put))
    return F.struct(out.alias("text"), *[n.cast("long").alias(kind) for kind, n in counts.items()])


def audit(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, kind and level (blocker, warning) of each finding; example addresses are none."""
    t = F.coalesce(F.col(text), F.lit(""))
    any_of = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_count(t, p) > 0)
    emails = F.filter(F.regexp_extract_all(t, F.lit(EMAIL), 0), lambda e: ~F.lower(e).endswith("@example.com"))
    kind = lambda when, name, level: F.when(when, F.struct(F.lit(name).alias("kind"), F.lit(level).alias("level")))
    private = is_generated(F.col(path))
    found = F.array_compact(
        F.array(
            kind(private, "generated_or_private_file", "blocker"),
            kind(~private & any_of(SECRETS), "possible_secret", "blocker"),
            kind(~private & any_of(MACHINE_PATHS), "machine_specific_path", "blocker"),
            kind(~private & (F.size(emails) > 0), "possible_personal_email", "blocker"),
            kind(~private & (F.contains(t, F.lit(UNFINISHED[0])) | F.contains(t, F.lit(UNFINISHED[1]))), "unfinished_marker", "warning"),
        )
    )
    return files.select(F.col(path).alias("path"), F.explode(found).alias("f")).select("path", "f.*")


# Names of what tools leave behind.
GENERATED_DIRS = (".git", ".codex-runtime", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__", "node_modules")
GENERATED_FILES = (".DS_Store", "Thumbs.db", "desktop.ini")
GENERATED_SUFFIXES = ("pyc", "pyo", "tmp", "bak", "swp", "log", "sqlite", "sqlite3")


def is_generated(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, GENERATED_DIRS))) | name.isin(*GENERATED_FILES) | suffix.isin(*GENERATED_SUFFIXES) | (name == ".env") | name.startswith(".env.")
