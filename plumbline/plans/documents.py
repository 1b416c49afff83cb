"""Queries over documents, labels, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import hashing, redact
from plumbline.functions import text as X
from plumbline.operators import corpus, digests, joins

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


_add(
    "doc_title_key",
    lambda s, d: docs(s, d).select("doc_id", F.sha2(X.title_words(F.col("text")), 256).alias("words_sha"), F.sha2(X.title_key(F.col("text")), 256).alias("key_sha")),
    r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^0-9a-z\x{4e00}-\x{9fff}]+', ' ', 'g'))) AS words_sha, sha256(regexp_replace(lower(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')), '[^a-z0-9]+', '', 'g')) AS key_sha FROM documents".replace('\\"', '"'),
)
_add(
    "doc_word_like_count",
    lambda s, d: docs(s, d).select("doc_id", X.word_like_count(F.col("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_points")),
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9μ×%]+|[\x{4e00}-\x{9fff}]')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_points FROM documents",
)
_add(
    "doc_signature_norm",
    lambda s, d: docs(s, d).select("doc_id", F.sha2(X.error_signature(F.col("text")), 256).alias("signature")),
    r"SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bline\s+[0-9]+\b', 'line <n>', 'g'), '(?i)\bpid[ =:]+[0-9]+\b', 'pid <n>', 'g'), '[\s\v]+', ' ', 'g')))) AS signature FROM documents",
)
_add(
    "doc_redaction_counts",
    lambda s, d: docs(s, d).select("doc_id", redact.redacted(F.col("text")).alias("r")).select("doc_id", "r.possible_secret", "r.machine_specific_path", "r.personal_email"),
)
_add(
    "doc_redacted_text",
    lambda s, d: docs(s, d).select("doc_id", redact.redacted(F.col("text"))["text"].alias("text")).select("doc_id", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("n")),
)
_SQL_SECRETS = [r"\bgh[opsu]_[A-Za-z0-9]{20,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"""(?i)\b(?:api[_-]?key|access[_-]?token|password|secret)\b\s*[:=]\s*[''"]?[A-Za-z0-9_./+\-=]{12,}"""]
_SQL_PATHS = [r"(?i)[A-Za-z]:\\Users\\[^\\\s]+", r"/home/[^/\s]+", r"/Users/[^/\s]+"]
_SQL_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


def _sql_redaction() -> tuple[str, dict[str, str]]:
    out, counts = "text", {}
    for kind, patterns, put in (("possible_secret", _SQL_SECRETS, "<REDACTED_SECRET>"), ("machine_specific_path", _SQL_PATHS, "<USER_HOME>"), ("personal_email", [_SQL_EMAIL], "<YOUR_EMAIL>")):
        terms = []
        for pattern in patterns:
            terms.append(f"len(regexp_extract_all({out}, '{pattern}'))")
            out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
        counts[kind] = f"CAST({' + '.join(terms)} AS BIGINT) AS {kind}"
    return out, counts


_REDACTED, _COUNTS = _sql_redaction()
ORACLE_SQL["doc_redaction_counts"] = f"SELECT doc_id, {', '.join(_COUNTS.values())} FROM documents"
ORACLE_SQL["doc_redacted_text"] = f"SELECT doc_id, sha256({_REDACTED}) AS text_sha, CAST(length({_REDACTED}) AS BIGINT) AS n FROM documents"

_add(
    "doc_secret_audit",
    lambda s, d: redact.audit(docs(s, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))),
    f"SELECT path, unnest(list_filter([CASE WHEN {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in _SQL_SECRETS)} THEN 'possible_secret' END, CASE WHEN {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in _SQL_PATHS)} THEN 'machine_specific_path' END, CASE WHEN len(list_filter(regexp_extract_all(text, '{_SQL_EMAIL}'), lambda e: NOT ends_with(lower(e), '@example.com'))) > 0 THEN 'possible_personal_email' END], lambda k: k IS NOT NULL)) AS kind, 'blocker' AS level FROM (SELECT 'd' || doc_id || '.md' AS path, text FROM documents WHERE text NOT LIKE '%TO' || 'DO%' AND text NOT LIKE '%TB' || 'D%')",
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus records: the head is the title, the body the abstract, the source stands for a venue."""
    venues = F.array(*map(F.lit, X.WHITELIST))
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    rows = docs(spark, sf_dir).select(
        F.col("doc_id").alias("ord"), F.substring_index("text", ".", 1).alias("title"), F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 20 + 5).cast("string"), 2, "0")).alias("venue_time"),
        F.when(n < 18, F.get(venues, n)).when(n == 18, "arXiv").otherwise("Elsewhere").alias("source"), F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 7 == 1, F.lit("https://blog.example.com/x")).otherwise(F.concat(F.lit("https://doi.org/10.1000/"), F.col("doc_id").cast("string"))).alias("url"),
        (F.col("doc_id") % 13).cast("string").alias("citation"), F.when(F.col("doc_id") % 5 == 0, "lab").otherwise("").alias("lab_group"),
        F.when(F.col("doc_id") % 3 == 0, "https://ieeexplore.ieee.org/document/1").otherwise("").alias("abstract_source_url"),
    )
    return corpus.trimmed(rows)


_SQL_RECORDS = """
r AS (
  SELECT doc_id AS ord, trim(regexp_replace(split_part(text, '.', 1), '^\\s+|\\s+$', '', 'g')) AS title, '20' || lpad(CAST(doc_id % 20 + 5 AS VARCHAR), 2, '0') AS venue_time,
    CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) < 18 THEN (['Nature','Science','Science Robotics','NMI','TPAMI','TRO','RAL','TNNLS','TMech','TASE','TITS','IJRR','ICRA','IROS','CoRL','CVPR','ICCV','NeurIPS'])[CAST(regexp_extract(source, '[0-9]+') AS INT) + 1]
         WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) = 18 THEN 'arXiv' ELSE 'Elsewhere' END AS source,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract,
    CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://blog.example.com/x' ELSE 'https://doi.org/10.1000/' || doc_id END AS url,
    CASE WHEN doc_id % 5 = 0 THEN 'lab' ELSE '' END AS lab_group, doc_id % 3 = 0 AS official_abstract
  FROM documents
)"""
_SQL_COMPLETE = "(length(abstract) >= 280 AND official_abstract AND NOT contains(lower(abstract), 'not available') AND NOT contains(lower(abstract), 'assistant summary') AND NOT contains(lower(abstract), 'brief summary') AND NOT contains(lower(abstract), 'summary only'))"
_add(
    "doc_gate_audit",
    lambda s, d: records(s, d).select("ord", corpus.strict_audit().alias("v")).select("ord", "v.status", "v.reason"),
    f"""WITH {_SQL_RECORDS} SELECT ord, CASE WHEN title = '' OR url = '' OR source = 'arXiv' THEN 'reject' WHEN source = 'Elsewhere' THEN 'needs_verification' WHEN doc7 = 1 OR NOT {_SQL_COMPLETE} OR gate IS NOT NULL THEN 'reject' ELSE 'accepted' END AS status,
    CASE WHEN title = '' OR url = '' THEN 'missing title or official URL' WHEN source = 'arXiv' THEN 'excluded or arXiv-only source' WHEN source = 'Elsewhere' THEN 'venue is not a recognized abbreviation' WHEN doc7 = 1 THEN 'URL is not a DOI, publisher, or official proceedings record' WHEN NOT {_SQL_COMPLETE} THEN 'missing complete original abstract or official abstract source URL' WHEN gate IS NOT NULL THEN gate ELSE 'passes strict corpus audit' END AS reason
    FROM (SELECT *, ord % 7 AS doc7, CASE WHEN regexp_matches(title || ' ' || abstract, '(?i)\\b(?:vla|vlm|llm)\\b|vision[- ]language|large language model') THEN 'VLA/VLM/LLM or vision-language content' WHEN regexp_matches(title || ' ' || abstract, '(?i)event[- ]based|event camera') THEN 'event-camera content' WHEN regexp_matches(title || ' ' || abstract, '(?i)\\bswarm\\b|marsupial') THEN 'multi-UAV/swarm content' WHEN regexp_matches(title || ' ' || abstract, '(?i)\\b(?:survey|literature review)\\b') THEN 'survey/literature-review content' END AS gate FROM r)""",
)
_add(
    "doc_complete_abstract",
    lambda s, d: records(s, d).select("ord", corpus.complete_abstract().alias("complete"), corpus.evidence_level().alias("level")),
    f"WITH {_SQL_RECORDS} SELECT ord, {_SQL_COMPLETE} AS complete, CASE WHEN {_SQL_COMPLETE} THEN 'abstract' ELSE 'none' END AS level FROM r",
)
_add(
    "doc_corpus_metrics",
    lambda s, d: corpus.metrics(records(s, d)),
    f"WITH {_SQL_RECORDS} SELECT 'venue' AS measure, source AS value, count(*) AS n FROM r GROUP BY source UNION ALL SELECT 'year', venue_time, count(*) FROM r GROUP BY venue_time UNION ALL SELECT 'lab', lab_group, count(*) FROM r WHERE lab_group <> '' GROUP BY lab_group UNION ALL SELECT 'total', '', count(*) FROM r",
)
_add(
    "doc_source_lang_counts",
    lambda s, d: docs(s, d).rollup("source", "lang").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")),
    "SELECT source, lang, CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)",
)
_add(
    "doc_metrics_cube",
    lambda s, d: docs(s, d).cube("source", "lang").agg(F.count(F.lit(1)).alias("n")),
    "SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)",
)
_add(
    "doc_source_table",
    lambda s, d: corpus.source_table(records(s, d)),
    f"WITH {_SQL_RECORDS} SELECT source, count(*) AS n FROM r GROUP BY source",
)
_add(
    "doc_year_table",
    lambda s, d: corpus.year_table(records(s, d)),
    f"WITH {_SQL_RECORDS} SELECT venue_time AS year, count(*) AS n FROM r GROUP BY venue_time",
)
_add(
    "doc_exact_dup_groups",
    lambda s, d: joins.duplicate_groups(docs(s, d).select("doc_id", F.array(F.concat(F.lit("t:"), F.sha2("text", 256)), F.concat(F.lit("k:"), F.sha2(X.title_key(F.col("text")), 256))).alias("keys")), "doc_id", "keys").select("key", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n")),
    """WITH k AS (SELECT doc_id, 't:' || sha256(text) AS key FROM documents UNION ALL SELECT doc_id, 'k:' || sha256(regexp_replace(lower(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')), '[^a-z0-9]+', '', 'g')) FROM documents)
    SELECT key, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1""",
)
_add(
    "doc_label_left",
    lambda s, d: docs(s, d).join(_table(s, d, "labels"), "doc_id", "left").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled")),
    "SELECT lang, quality, count(*) AS n, count(toxic) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality",
)
_add(
    "doc_label_semi",
    lambda s, d: docs(s, d).join(_table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang"),
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
_add(
    "doc_label_anti",
    lambda s, d: docs(s, d).join(_table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source"),
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
_add(
    "doc_label_overlay",
    lambda s, d: joins.overlay(docs(s, d).select("doc_id", F.lit("local").alias("origin"), F.when(F.col("doc_id") % 2 == 0, 9).alias("quality")), _table(s, d, "labels").select("doc_id", F.lit("public").alias("origin"), "quality"), "doc_id"),
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'public' ELSE 'local' END AS origin, coalesce(CASE WHEN a.doc_id % 2 = 0 THEN 9 END, b.quality) AS quality FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id",
)
_add(
    "doc_three_way_state",
    lambda s, d: joins.three_way(*[docs(s, d).select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % k == 0, "edited").otherwise(F.col("lang")).alias("digest")) for k in (6, 7, 9)]).groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    """WITH j AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'edited' ELSE lang END AS b, CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE lang END AS l, CASE WHEN doc_id % 9 = 0 THEN 'edited' ELSE lang END AS r FROM documents)
    SELECT CASE WHEN l IS NOT DISTINCT FROM r THEN 'equal' WHEN b IS NOT DISTINCT FROM l THEN 'right-changed' WHEN b IS NOT DISTINCT FROM r THEN 'left-changed' ELSE 'conflict' END AS state, count(*) AS n FROM j GROUP BY 1""",
)
_add(
    "doc_set_operations",
    lambda s, d: joins.set_counts(docs(s, d).select("doc_id"), _table(s, d, "labels").select("doc_id")),
    "SELECT 'union' AS operation, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'union_all', (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)",
)
_add(
    "bench_passage_hits",
    lambda s, d: joins.contained_passages(docs(s, d), _table(s, d, "benchmark")),
    "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
_add(
    "doc_ids",
    lambda s, d: docs(s, d).select("doc_id", hashing.joined_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"), hashing.short_hash(F.col("source"), F.col("lang")).alias("short"), hashing.task_id(F.col("source"), F.col("lang")).alias("task")),
    "SELECT doc_id, substr(sha256(lower(source) || chr(10) || lower(lang) || chr(10) || doc_id), 1, 20) AS id, substr(sha256(source || chr(31) || lang), 1, 16) AS short, source || ':' || substr(sha256(source || chr(0) || lang), 1, 16) AS task FROM documents",
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's tree, in two folders whose names sort unlike their paths."""
    folder = F.when(F.col("doc_id") % 2 == 0, "a.b").otherwise("a")
    return docs(spark, sf_dir).select("source", F.concat_ws("/", folder, F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))


_SQL_FILES = "SELECT source, lang, text, CASE WHEN doc_id % 2 = 0 THEN 'a.b' ELSE 'a' END AS folder, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name FROM documents"
_add(
    "doc_source_digest",
    lambda s, d: digests.package_digests(_files(s, d), "source").withColumnRenamed("digest", "tree").join(docs(s, d).groupBy("source").agg(hashing.set_digest(F.collect_set(F.col("lang"))).alias("langs")), "source"),
    f"SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, sha256(string_agg(folder || '/' || name || chr(0) || sha256(text) || chr(10), '' ORDER BY folder, name)) AS tree FROM ({_SQL_FILES}) GROUP BY source",
)
_add(
    "doc_tree_digest",
    lambda s, d: digests.tree_digests(_files(s, d), "source"),
    f"SELECT source, sha256(unhex(string_agg(printf('%016x', strlen(folder || '/' || name)) || hex(folder || '/' || name) || printf('%016x', strlen(text)) || hex(text), '' ORDER BY folder, name))) AS digest FROM ({_SQL_FILES}) GROUP BY source",
)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


def _protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: turns, whether they are 0..n-1 once each, whether a user starts, whether roles alternate."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    turns = conversations(spark, sf_dir).withColumn("before", F.lag("role").over(order))
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        ((F.countDistinct("turn") == F.count(F.lit(1))) & (F.min("turn") == 0) & (F.max("turn") == F.count(F.lit(1)) - 1)).alias("contiguous"),
        (F.min_by("role", "turn") == "user").alias("user_first"),
        (F.sum(F.when(F.col("role") == F.col("before"), 1).otherwise(0)) == 0).alias("alternates"),
        F.max_by("role", "turn").alias("last_role"),
    )


_add(
    "conv_turn_protocol",
    _protocol,
    "WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous, arg_min(role, turn) = 'user' AS user_first, count(*) FILTER (role = before) = 0 AS alternates, arg_max(role, turn) AS last_role FROM t GROUP BY conv_id",
)
_add(
    "conv_section_segments",
    lambda s, d: conversations(s, d).withColumn("section", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))).groupBy("conv_id", "section").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars")),
    "SELECT conv_id, section, min(turn) AS first_turn, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM conversations) GROUP BY conv_id, section",
)
_add(
    "entity_resolution_fold",
    lambda s, d: corpus.resolve_entities(records(s, d).withColumn("url", F.when(F.col("ord") % 11 == 0, F.col("url")).otherwise(""))).select("ord", "title", "citation", "source"),
)
_add(
    "emb_label_overlap",
    lambda s, d: _table(s, d, "embeddings").groupBy((F.col("vec_id") % 10).alias("part")).agg(F.array_sort(F.collect_set("label")).alias("labels")).select("part", F.array_join("labels", ",").alias("labels"), (F.size(F.array_except(F.array(*map(F.lit, range(10))), "labels")) == 0).alias("covers_all")),
    "SELECT vec_id % 10 AS part, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels, count(DISTINCT label) FILTER (label BETWEEN 0 AND 9) = 10 AS covers_all FROM embeddings GROUP BY 1",
)
