"""Queries over quotes, sitemaps, libraries, annotations, notices and groups of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lineage import shared_folder
from plumbline.operators import annotations, blocks, corpus, evidence, joins, ledger, registry, scan
from plumbline.sources import files, pages
from plumbline.sources.versions import Versions
from plumbline.streaming import groups, leases

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


def _rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


_add(
    "bench_quote_context",
    lambda s, d: joins.occurrences(_rows(s, d, "documents", "doc_id AS page", "split(text, ' ') AS tokens"), _rows(s, d, "benchmark", "item_id AS quote", "slice(split(text, ' '), 3, 2) AS tokens", "slice(split(text, ' '), 2, 1) AS before", "CASE WHEN item_id % 2 = 0 THEN slice(split(text, ' '), 5, 3) END AS after")),
    """WITH e AS (SELECT page, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id AS page, string_split(text, ' ') AS t FROM documents)), q AS (SELECT item_id AS quote, string_split(text, ' ') AS t FROM benchmark)
    SELECT page, quote, CAST(i - 1 AS INT) AS place FROM (SELECT *, e.t AS x, q.t AS y FROM e JOIN q ON e.t[i] = q.t[3] AND e.t[i + 1] = q.t[4]) WHERE i > 1 AND x[i - 1] = y[2] AND (quote % 2 = 1 OR x[i + 2:i + 1 + len(y[5:7])] = y[5:7])""",
)

_CHILDREN = "concat(array(concat('s', CAST(2 * k AS STRING)), concat('s', CAST(2 * k + 1 AS STRING))), CASE WHEN k % 7 = 0 THEN array(concat('s', CAST(k DIV 2 AS STRING))) ELSE array() END)"


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sitemaps: k names 2k and 2k + 1, every seventh also the one that names it; some cannot be read, some are named but not there."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey").alias("n"))
    k = _rows(spark, sf_dir, "part", "p_partkey + 1 AS k").join(F.broadcast(n))
    return k.selectExpr("concat('s', CAST(CASE WHEN k % 211 = 210 THEN -k ELSE k END AS STRING)) AS path", "CASE WHEN 2 * k > n THEN 'urlset' ELSE 'index' END AS kind", f"CASE WHEN 2 * k > n THEN CAST(array() AS array<string>) ELSE {_CHILDREN} END AS child_sitemaps", "CASE WHEN k % 101 = 100 THEN 'invalid-xml' END AS problem")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "nation", "concat('s', CAST(n_nationkey + 1 AS STRING)) AS url", "concat('o', CAST(n_regionkey AS STRING)) AS origin")


_add(
    "part_sitemap_completion",
    lambda s, d: pages.sitemap_completion(_sitemaps(s, d), _seeds(s, d), 30).select("url", "depth", "complete"),
    """WITH RECURSIVE m AS (SELECT max(p_partkey) AS n FROM part), t AS (SELECT CASE WHEN p_partkey % 211 = 209 THEN -p_partkey - 1 ELSE p_partkey + 1 END AS k, (p_partkey + 1) % 101 = 100 AS bad, 2 * (p_partkey + 1) > n AS leaf, p_partkey + 1 AS i FROM part, m),
    e AS (SELECT k AS a, unnest([2 * i, 2 * i + 1] || CASE WHEN i % 7 = 0 THEN [i // 2] ELSE [] END) AS b FROM t WHERE NOT leaf AND NOT bad),
    near AS (SELECT n_nationkey + 1 AS k, 0 AS depth FROM nation UNION SELECT e.b, depth + 1 FROM near JOIN e ON e.a = near.k WHERE depth < 30 AND e.b > near.k), l AS (SELECT k, min(depth) AS depth FROM near GROUP BY k),
    up AS (SELECT l.k FROM l LEFT JOIN t ON t.k = l.k WHERE t.k IS NULL OR t.bad UNION SELECT e.a FROM up JOIN e ON e.b = up.k JOIN l ON l.k = e.a)
    SELECT 's' || l.k AS url, CAST(depth AS INT) AS depth, l.k NOT IN (SELECT k FROM up) AS complete FROM l""",
)
_add("part_sitemap_origins", lambda s, d: pages.exhaustive_origins(pages.sitemap_completion(_sitemaps(s, d), _seeds(s, d), 30), _seeds(s, d)), f"SELECT DISTINCT 'o' || n_regionkey AS origin FROM nation JOIN ({ORACLE_SQL['part_sitemap_completion']}) ON url = 's' || (n_nationkey + 1) WHERE complete")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers of an index, and as items and attachments of a library whose keys, identifiers and titles half agree."""
    records = _rows(spark, sf_dir, "part", "p_partkey AS number", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('10.', CAST(p_partkey AS STRING)) END AS doi", "lower(p_name) AS title_key", "CASE WHEN p_partkey % 5 = 0 THEN concat('a', CAST(p_partkey AS STRING)) END AS link_key")
    parents = _rows(spark, sf_dir, "part", "concat('p', CAST(p_partkey AS STRING)) AS key", "CASE WHEN p_partkey % 2 = 0 THEN concat('10.', CAST(p_partkey + 1 AS STRING)) ELSE '' END AS doi", "CASE WHEN p_size > 10 THEN lower(p_name) ELSE '' END AS title_key", "p_size % 3 AS creators", "p_type AS date", "CASE WHEN p_size % 4 > 0 THEN p_brand END AS venue", "p_brand AS url")
    attachments = _rows(spark, sf_dir, "part", "concat('a', CAST(p_partkey AS STRING)) AS key", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat('p', CAST(p_partkey DIV 2 AS STRING)) END AS parent")
    return joins.aligned(records, parents, attachments)


_add(
    "part_library_alignment",
    lambda s, d: _library(s, d).withColumn("missing", F.array_join("missing", ",")),
    """WITH r AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 3 > 0 THEN '10.' || p_partkey END AS doi, lower(p_name) AS title, CASE WHEN p_partkey % 5 = 0 THEN 'a' || p_partkey END AS link FROM part),
    p AS (SELECT 'p' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN '10.' || (p_partkey + 1) END AS doi, CASE WHEN p_size > 10 THEN lower(p_name) END AS title, concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'doi' END, CASE WHEN p_size % 3 = 0 THEN 'creators' END, CASE WHEN p_size % 4 = 0 THEN 'venue' END) AS missing FROM part),
    a AS (SELECT 'a' || p_partkey AS key, CASE WHEN p_partkey % 10 <> 0 THEN 'p' || p_partkey // 2 END AS parent FROM part),
    f AS (SELECT number, parent, 1 AS s FROM r JOIN a ON a.key = r.link JOIN p ON p.key = a.parent UNION SELECT number, key, 2 FROM r JOIN p ON r.doi = p.doi UNION SELECT number, key, 3 FROM r JOIN p ON r.title = p.title),
    g AS (SELECT number, s, min(parent) AS parent, count(*) AS candidates FROM f GROUP BY number, s), b AS (SELECT * FROM g QUALIFY s = min(s) OVER (PARTITION BY number))
    SELECT r.number, b.parent, ['link', 'doi', 'title'][b.s] AS stage, coalesce(candidates, 0) AS candidates, CASE WHEN b.parent IS NULL THEN 0 ELSE (SELECT count(*) FROM a WHERE a.parent = b.parent) END AS children, CASE WHEN b.parent IS NULL THEN 0 ELSE (SELECT count(*) FROM b c WHERE c.parent = b.parent) END AS claimed, coalesce((SELECT missing FROM p WHERE key = b.parent), '') AS missing
    FROM r LEFT JOIN b ON b.number = r.number""",
)
_add(
    "doc_notices",
    lambda s, d: _rows(s, d, "documents", "doc_id", "source", "lower(coalesce(text, '')) AS text").select("doc_id", registry.notice(F.col("source"), F.col("text")).alias("notice")),
    "WITH s AS (SELECT doc_id, lower(source || ' ' || coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN {' AND '.join('(' + ' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words) + ')' for words in rule)} THEN '{text}'" for rule, text in registry.NOTICES)
    + f" ELSE '{registry.NOTICE}' END AS notice FROM s",
)
_add(
    "doc_to_enrich",
    lambda s, d: corpus.to_enrich(_rows(s, d, "documents", "doc_id AS ord", "text AS abstract", "CASE WHEN doc_id % 3 = 0 THEN source ELSE ' ' END AS abstract_source_url", "CASE WHEN doc_id % 4 = 0 THEN '2024-01-01' END AS verification_date"), 200),
    "WITH o AS (SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE NOT (doc_id % 3 = 0 AND length(trim(text)) >= 280) AND doc_id % 4 <> 0) SELECT doc_id AS ord, coalesce(n <= 200, false) AS process FROM documents LEFT JOIN o ON ord = doc_id",
)


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as annotations of all modes."""
    i = "doc_id"
    return _rows(
        spark, sf_dir, "documents", f"{i} AS id", "'1' AS page", f"CASE WHEN {i} % 11 = 10 THEN 'area' ELSE 'highlight' END AS annotation_type", f"CASE WHEN {i} % 17 = 0 THEN '' ELSE 'author-background' END AS kind", "'c' AS color", "'q' AS note_question",
        "coalesce(text, '') || ' x' AS claim", "'why this was chosen here and now' AS reason", f"CASE {i} % 4 WHEN 0 THEN array('method') WHEN 1 THEN array('method', 'result') WHEN 2 THEN array('odd', 'author_context') ELSE array('support_link') END AS information_roles", "'e' AS evidence", "'1' AS confidence",
        f"CASE {i} % 5 WHEN 0 THEN 'semantic-span' WHEN 1 THEN 'key-term' WHEN 2 THEN 'key-metric' WHEN 3 THEN 'key-link' ELSE 'author-name' END AS selection_mode", f"CASE WHEN {i} % 3 = 0 THEN 'https://x.org/1' WHEN {i} % 3 = 1 THEN 'We  Propose' ELSE '12.5' END AS quote",
        "'s' AS context_summary", f"CASE WHEN {i} % 2 = 0 THEN 'm' END AS metric_context", "'k' AS condition", "'l' AS link_context", "'a' AS author_context", "'https://y.org' AS external_evidence", f"CASE WHEN {i} % 7 = 0 THEN '2024-02-31' ELSE '2024-02-28' END AS verified_at", f"CASE WHEN {i} % 13 = 0 THEN '' ELSE '外部核验，不是论文正文事实：x' END AS annotation_comment", "array('1', '2', '3') AS rect",
    )


_add(
    "doc_annotation_faults",
    lambda s, d: annotations.information_faults(_annotations(s, d)).select("id", F.array_join("faults", "; ").alias("faults")),
    """WITH i AS (SELECT doc_id AS id, doc_id % 5 AS m, doc_id % 3 AS q, doc_id % 4 AS r, doc_id % 11 = 10 AS area, doc_id % 13 = 0 AS nc, len(regexp_extract_all(coalesce(text, '') || ' x', '[A-Za-z0-9μ×%]+|[一-鿿]')) < 6 AS thin FROM documents)
    SELECT id, CASE WHEN id % 17 = 0 THEN 'missing: kind' ELSE concat_ws('; ', CASE WHEN r = 2 THEN 'unknown roles: odd' END, CASE WHEN area AND m > 0 THEN 'mode needs a highlight' END,
      CASE WHEN NOT area AND m = 2 AND q = 1 THEN 'key-metric has no number' END, CASE WHEN NOT area AND m = 3 AND q > 0 THEN 'key-link is no public address' END, CASE WHEN NOT area AND m = 4 AND r <> 2 THEN 'author-name lacks its role' END,
      CASE WHEN NOT area AND m = 1 AND nc THEN 'key-term lacks annotation_comment' END, CASE WHEN NOT area AND m = 2 AND id % 2 = 1 THEN 'key-metric lacks metric_context' END, CASE WHEN NOT area AND m = 2 AND nc THEN 'key-metric lacks annotation_comment' END,
      CASE WHEN NOT area AND m = 3 AND nc THEN 'key-link lacks annotation_comment' END, CASE WHEN NOT area AND m = 4 AND nc THEN 'author-name lacks annotation_comment' END, CASE WHEN NOT area AND m = 3 AND r <> 3 THEN 'key-link lacks its role' END,
      CASE WHEN NOT area AND m = 4 AND id % 7 = 0 THEN 'author-name date is no date' END, CASE WHEN NOT area AND m = 0 AND q = 1 THEN 'quote is a fragment' END, CASE WHEN NOT area AND m = 0 AND q = 2 THEN 'number without context' END,
      CASE WHEN NOT area AND m = 0 THEN 'quote is too short' END, CASE WHEN NOT area AND m = 0 AND r = 0 THEN 'method without mechanism or result' END, CASE WHEN area AND m = 0 THEN 'area lacks visual_object; area lacks its rectangle' END, CASE WHEN area AND m = 0 AND r <> 1 THEN 'area lacks a role of evidence' END, CASE WHEN thin THEN 'claim explains nothing' END) END AS faults FROM i""",
)


def _group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks of a group with their items as results: a first run in which some fail, and a second one."""
    numbered = scan.numbered(_rows(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey"], "ord").select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderkey").alias("k"), "ord")
    store = Versions(spark, f"{shared_folder(spark)}/group-{uuid.uuid4().hex}")
    for attempt, ok in ((1, "k % 701 <> 700"), (2, "k % 5003 <> 5002")):
        tasks = numbered.select("task_id", "ord", F.lit(attempt).alias("attempt"), F.expr(ok).alias("ok"))
        results = _rows(spark, sf_dir, "lineitem", "CAST(l_orderkey AS STRING) AS task_id", f"{attempt} AS attempt", f"l_quantity * {attempt} AS value")
        groups.commit_group(store, tasks, results)
    store.clean(1)
    return store.read("rows").groupBy("task_id", "ord").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


_add(
    "ord_group_commit",
    _group_commit,
    """WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders), f AS (SELECT coalesce(min(ord) FILTER (k % 701 = 700), 9e18) AS one FROM o), g AS (SELECT coalesce(min(ord) FILTER (k % 5003 = 5002 AND ord >= one), 9e18) AS two FROM o, f)
    SELECT CAST(k AS VARCHAR) AS task_id, ord, count(*) AS n, round(sum(l_quantity * CASE WHEN ord < one THEN 1 ELSE 2 END), 4) AS value FROM o, f, g, lineitem WHERE l_orderkey = k AND ord < two GROUP BY k, ord""",
)


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of channels: pages, an interface and a catalogue by type, tasks by user."""
    e, i = "event_id", "event_id % 10"
    return _rows(
        spark, sf_dir, "events", "event_type AS channel", "CASE WHEN event_type = 'view' THEN 'page' ELSE 'api' END AS adapter", f"{e} AS ord", "CAST(ts AS TIMESTAMP) AS at", f"CASE WHEN {i} < 4 THEN 'lease' WHEN {i} < 6 THEN 'done' WHEN {i} = 6 THEN 'signal' WHEN {i} = 7 THEN 'missed' WHEN {i} = 8 THEN 'made_up' WHEN {e} % 100 = 9 THEN 'session' ELSE 'failed' END AS kind",
        f"CAST(user_id % 40 AS STRING) AS task_id", "'x' AS lease_id", "value * 600D AS seconds", f"CAST({e} AS STRING) AS session_id", "value > 45 AS rate_limited", "2 AS rate_limit_streak", "0D AS error_rate", "1D AS latency_ratio", "CASE WHEN value > 25 THEN 0.5D END AS captcha_rate", "CAST(NULL AS DOUBLE) AS empty_body_rate", "64 AS tool_limit", "CAST(NULL AS INT) AS host_limit", "CAST(user_id % 30 AS STRING) AS query_id",
    )


#: Its rules need each state before; tests/test_reading.py holds every row against a brute-force version.
_add("ev_channel_fold", lambda s, d: leases.channel_fold(_channels(s, d)))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: a folded callout with the text's lines, a quote inside it, and every third one with a fence around its end."""
    n = "CAST(doc_id AS STRING)"
    quoted = "concat('> ', replace(replace(coalesce(text, ''), '>', ' '), '\\n', '\\n> '))"
    return _rows(spark, sf_dir, "documents", f"concat('d/', {n}, '.md') AS path", f"concat('> [!Info]- Doc ', {n}, '\\n', {quoted}, '\\n> > inner ^b-', {n}, '\\n', CASE WHEN doc_id % 3 = 0 THEN '```\\n> [!no] code' ELSE '> [!tip] last' END) AS content")


_LINES = "len(string_split(coalesce(text, ''), chr(10)))"
_add(
    "doc_note_blocks",
    lambda s, d: blocks.blocks(_noted(s, d)),
    f"""WITH d AS (SELECT 'd/' || doc_id || '.md' AS path, doc_id, {_LINES} AS n FROM documents)
    SELECT path, 1 AS line, CAST(n + 2 AS INT) AS last, 1 AS depth, 'info' AS type, true AS folded, 'Doc ' || doc_id AS title, NULL::INT AS parent, NULL AS block_id FROM d
    UNION ALL SELECT path, CAST(n + 2 AS INT), CAST(n + 2 AS INT), 2, 'quote', false, '', 1, 'b-' || doc_id FROM d
    UNION ALL SELECT path, CAST(n + 3 AS INT), CAST(n + 3 AS INT), 1, 'tip', false, 'last', NULL, NULL FROM d WHERE doc_id % 3 > 0""",
)
_add(
    "doc_note_without_code",
    lambda s, d: blocks.without_code(_noted(s, d)).select("path", F.sha2("text", 256).alias("sha"), "unclosed"),
    f"""WITH d AS (SELECT doc_id, {_LINES} AS n, '> [!Info]- Doc ' || doc_id || chr(10) || '> ' || replace(replace(coalesce(text, ''), '>', ' '), chr(10), chr(10) || '> ') || chr(10) || '> > inner ^b-' || doc_id || chr(10) AS body FROM documents)
    SELECT 'd/' || doc_id || '.md' AS path, sha256(body || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '> [!tip] last' END) AS sha, CASE WHEN doc_id % 3 = 0 THEN CAST(n + 3 AS INT) END AS unclosed FROM d""",
)


_RECOVERY = ("CAST(event_id AS STRING) AS id", "CASE WHEN event_id % 19 = 0 THEN ' ' ELSE 'run' END AS run_id", "CASE WHEN user_id % 9 = 0 THEN 'other' WHEN user_id % 2 = 0 THEN 'JD ' ELSE 'taobao' END AS platform", "event_type AS query_family", "user_id % 520 AS page_number", "CASE event_id % 3 WHEN 0 THEN 'Initial' WHEN 1 THEN 'reproject' ELSE 'reload' END AS recovery_stage", "CASE WHEN event_id % 13 = 0 THEN 1 ELSE CAST(event_id % 3 AS INT) END AS attempt")


def _recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recoveries of all categories in turn, some with faults."""
    names = list(ledger.DISPOSITIONS)
    category = F.get(F.array(*map(F.lit, [*names, "odd"])), (F.col("user_id") % (len(names) + 1)).cast("int"))
    rows = _rows(spark, sf_dir, "events", *_RECOVERY, "user_id", "event_id").withColumn("category", category)
    return ledger.with_disposition(rows).withColumn("disposition", F.when(F.col("event_id") % 17 == 0, "wrong").otherwise(F.coalesce("disposition", F.lit("none")))).drop("user_id", "event_id")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recoveries(spark, sf_dir)
    kept, refused = ledger.append_recoveries(rows.limit(0), rows)
    return kept.select("id", "platform", "recovery_stage", "category", F.lit("").alias("faults")).unionByName(refused.select("id", "platform", "recovery_stage", "category", F.array_join("faults", "; ").alias("faults")))


_NAMES = list(ledger.DISPOSITIONS)
_add(
    "ev_recovery_append",
    _appended,
    f"""WITH c AS (SELECT *, {[*_NAMES, "odd"]}[user_id % {len(_NAMES) + 1} + 1] AS cat FROM events),
    f AS (SELECT CAST(event_id AS VARCHAR) AS id, user_id, event_id, cat, concat_ws('; ', CASE WHEN event_id % 19 = 0 THEN 'run_id is empty or too long' END, CASE WHEN user_id % 9 = 0 THEN 'unknown platform' END, CASE WHEN user_id % 520 NOT BETWEEN 1 AND 512 THEN 'page out of bounds' END,
      CASE WHEN event_id % 13 = 0 AND event_id % 3 <> 1 THEN 'attempt is not the stage''s' END, CASE WHEN cat = 'odd' THEN 'unknown category' END, CASE WHEN cat <> 'odd' AND event_id % 17 = 0 THEN 'disposition is not the category''s' END) AS faults FROM c)
    SELECT id, CASE WHEN user_id % 9 = 0 THEN 'other' WHEN user_id % 2 = 0 THEN CASE WHEN faults = '' THEN 'jd' ELSE 'JD ' END ELSE 'taobao' END AS platform, CASE event_id % 3 WHEN 0 THEN CASE WHEN faults = '' THEN 'initial' ELSE 'Initial' END WHEN 1 THEN 'reproject' ELSE 'reload' END AS recovery_stage, cat AS category, faults FROM f""",
)
_add("ev_failure_histogram", lambda s, d: ledger.failure_histogram(_recoveries(s, d)), f"SELECT {[*_NAMES, 'odd']}[user_id % {len(_NAMES) + 1} + 1] AS category, count(*) AS n FROM events GROUP BY 1")
_add(
    "cust_supp_concatenated",
    lambda s, d: joins.concatenated(_rows(s, d, "customer", "c_acctbal AS bal", "c_custkey AS ord", "c_name AS name"), _rows(s, d, "supplier", "s_acctbal AS bal", "-s_suppkey AS ord", "s_name AS name")).select("ord", "name", "bal"),
    "SELECT row_number() OVER (ORDER BY t, o) AS ord, name, bal FROM (SELECT 0 AS t, c_custkey AS o, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT 1, -s_suppkey, s_name, s_acctbal FROM supplier)",
)
_add(
    "part_route_owners",
    lambda s, d: joins.route_owners(_rows(s, d, "part", "concat_ws('/', p_brand, p_type, CAST(p_partkey AS STRING)) AS path"), _rows(s, d, "part", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat_ws('/', p_brand, p_type, '') END AS prefix", "CASE WHEN p_size % 7 = 0 THEN 'second' ELSE 'first' END AS owner").distinct()),
    """WITH r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || '/' || p_type END AS prefix, CASE WHEN p_size % 7 = 0 THEN 'second' ELSE 'first' END AS owner FROM part), o AS (SELECT prefix, count(*) AS n, min(owner) AS owner FROM r GROUP BY prefix),
    p AS (SELECT p_brand || '/' || p_type || '/' || p_partkey AS path, p_brand AS b, p_brand || '/' || p_type AS t FROM part)
    SELECT path, CASE WHEN coalesce(x.n, y.n) = 1 THEN coalesce(x.owner, y.owner) END AS owner, coalesce(x.prefix, y.prefix) AS prefix, CASE WHEN coalesce(x.n, y.n) IS NULL THEN 'unknown' WHEN coalesce(x.n, y.n) > 1 THEN 'ambiguous' END AS fault FROM p LEFT JOIN o x ON x.prefix = t LEFT JOIN o y ON y.prefix = b""",
)


_STATES = list(files.STATES)
_add(
    "part_candidate_index",
    lambda s, d: files.candidate_index(_rows(s, d, "part", "concat('c', lpad(CAST(p_partkey AS STRING), 9, '0')) AS id", "concat('<', p_name, '|', p_brand, ']') AS title", "p_brand AS owner", f"element_at(array({', '.join(map(repr, _STATES))}), CAST(p_partkey % {len(_STATES)} AS INT) + 1) AS status", "p_type AS delta", "CASE WHEN p_size % 2 = 0 THEN concat(p_type, ' & more') END AS note")),
    f"""WITH c AS (SELECT 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_partkey % {len(_STATES)} AS s, '&lt;' || p_name || '&#124;' || p_brand || '&#93;' AS title, p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN p_type || ' &amp; more' ELSE '尚未审核' END AS note FROM part)
    SELECT row_number() OVER (ORDER BY s NOT IN (2, 3), id) AS place, '| [[候选分析/' || id || '|' || title || ']] | ' || p_brand || ' | ' || {list(files.STATES.values())}[s + 1] || ' | ' || p_type || '；' || note || ' |' AS line FROM c""",
)


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as states of runs, some of another schema or without an id."""
    states = _rows(spark, sf_dir, "orders", "CAST(o_orderkey AS STRING) AS k", "CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS schema_version", "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat(' r', o_orderkey) END AS run_id", "CASE WHEN o_orderstatus = 'O' THEN 'market_discovery' ELSE 'direct' END AS run_kind", "'u' AS canonical_urls")
    done, refused = evidence.state_v2(states, "ledgers/")
    return done.select("k", "schema_version", "run_type", "search_limit_seconds", "ledger_path", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("k", "reason"), allowMissingColumns=True)


_add(
    "ord_state_migration",
    _migrated,
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'not of the first schema' WHEN o_orderkey % 11 = 0 THEN 'run_id is empty' END AS reason, o_orderstatus AS s FROM orders)
    SELECT k, CASE WHEN reason IS NULL THEN 2 END AS schema_version, CASE WHEN reason IS NULL THEN CASE WHEN s = 'O' THEN 'open_web_research' ELSE 'quick_direct' END END AS run_type, CASE WHEN reason IS NULL THEN 600.0::DOUBLE END AS search_limit_seconds, CASE WHEN reason IS NULL THEN 'ledgers/r' || k || '.sqlite' END AS ledger_path, reason FROM o""",
)
