"""Queries for decisions, validators, controllers and streams, over the driver's tables as telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.lineage import shared_folder
from plumbline.operators import evidence, notes, registry, validation
from plumbline.operators import timeseries as S
from plumbline.streaming import controllers, ingest, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: price and keys stand for seconds, finds and states."""
    k = F.col("o_orderkey")
    scope = "struct<recent_candidate_additions:array<bigint>,query_generation_exhausted:boolean,healthy_cursors_open:int,healthy_cursors_blocked:int,edge_plan_completed:boolean,api_available:boolean,api_cursor_completed:boolean,untried_high_yield_families:int>"
    done = F.struct(F.array(F.lit(0), F.lit(1), F.lit(0)).cast("array<bigint>"), F.lit(True), F.lit(0), F.lit(0), F.lit(True), F.lit(False), F.lit(False), F.lit(0)).cast(scope)
    return _table(spark, sf_dir, "orders").select(k.alias("run"), (F.col("o_totalprice") / 600).alias("discovery_seconds"), (k % 9000).alias("total_unique_candidates"), (k % 700).alias("recent_window_candidates"), (k % 40).cast("double").alias("max_zero_gap_seconds"), ((k % 9000) * (1 + k % 15)).alias("raw_observations"), F.create_map(F.lit("jd"), F.when(F.col("o_orderstatus") == "P", "captcha").otherwise("ok")).alias("source_states"), F.when(k % 11 == 0, done).alias("scope"))


_add(
    "ord_marketplace_state",
    lambda s, d: evidence.marketplace_state(runs(s, d)).select("run", "state", "next_action", "acceptance_passed", F.round("duplicate_rate", 9).alias("duplicate_rate")),
    """WITH r AS (SELECT o_orderkey AS run, o_totalprice / 600 AS sec, o_orderkey % 9000 AS total, o_orderkey % 700 AS recent, o_orderkey % 40 AS gap, (o_orderkey % 9000) * (1 + o_orderkey % 15) AS raw, o_orderstatus = 'P' AS blocked, o_orderkey % 11 = 0 AS scope FROM orders),
    q AS (SELECT *, CASE WHEN raw = 0 THEN 0 ELSE greatest(0, 1 - total / raw) END AS dup, CASE WHEN sec = 0 THEN 0 ELSE total / sec END AS avg_rate FROM r),
    s AS (SELECT *, CASE WHEN sec >= 600 THEN 'ten_minute_limit' WHEN scope AND NOT blocked THEN 'deterministic_scope_complete' WHEN gap >= 30 THEN 'zero_window' WHEN blocked THEN 'source_blocked' WHEN sec < 30 THEN 'warmup' WHEN dup >= 0.9 AND recent / 30 < 10 THEN 'duplicate_saturation' WHEN recent / 30 < 10 THEN 'slow' ELSE 'healthy' END AS state FROM q)
    SELECT run, state, CASE state WHEN 'ten_minute_limit' THEN 'stop_time_limit' WHEN 'deterministic_scope_complete' THEN 'stop_scope_complete' WHEN 'zero_window' THEN 'switch_source' WHEN 'source_blocked' THEN 'cool_blocked_source' WHEN 'duplicate_saturation' THEN 'change_route_shape' WHEN 'slow' THEN 'expand_query_family' ELSE 'keep_routes' END AS next_action,
           sec >= 600 AND total >= 6000 AND avg_rate >= 10 AND gap < 30 AS acceptance_passed, round(dup, 9) AS duplicate_rate FROM s""",
)
_add(
    "ord_throughput_route",
    lambda s, d: evidence.throughput_route(runs(s, d).select("run", "discovery_seconds", (F.col("run") % 5).alias("batches"), F.col("raw_observations").alias("raw"), F.lit(30.0).alias("recent_seconds"), (F.col("run") % 3000).alias("recent_raw"), F.array(F.struct(F.lit("Map").alias("name"), F.lit("sitemap").alias("kind"), (F.col("run") % 3 > 0).alias("available"), (F.col("run") % 3 > 1).alias("attempted"))).alias("backends"))).select("run", "action", "backend", "reason", "must_disclose"),
    """WITH r AS (SELECT o_orderkey AS run, o_totalprice / 600 AS sec, o_orderkey % 5 AS b, (o_orderkey % 9000) * (1 + o_orderkey % 15) / (o_totalprice / 600) AS rate, o_orderkey % 3000 / 30 AS recent, o_orderkey % 3 AS m FROM orders),
    s AS (SELECT *, CASE WHEN sec < 5 OR b < 2 THEN 'warmup' WHEN rate >= 50 AND recent >= 50 THEN 'target-met' WHEN m = 1 THEN 'below-target-add-bulk-backend' WHEN m = 2 THEN 'bulk-backends-exhausted' ELSE 'bulk-backend-unavailable' END AS reason FROM r)
    SELECT run, CASE reason WHEN 'warmup' THEN 'continue' WHEN 'target-met' THEN 'continue' WHEN 'below-target-add-bulk-backend' THEN 'add_bulk_backend' WHEN 'bulk-backends-exhausted' THEN 'switch_query_family' ELSE 'search_only_degraded' END AS action, CASE WHEN reason = 'below-target-add-bulk-backend' THEN 'Map' END AS backend, reason, reason NOT IN ('warmup', 'target-met') AND sec >= 15 AS must_disclose FROM s""",
)
_add(
    "ord_progress_totals",
    lambda s, d: evidence.progress(_table(s, d, "orders").select(F.col("o_orderkey").alias("raw"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("valid"), (F.col("o_orderkey") / 2).cast("long").alias("unique"), F.lit(1).alias("domains"), F.col("o_orderkey").alias("source_sum"), F.lit(60.0).alias("seconds"))).select("raw", "valid", "unique", "domains", F.round("raw_rate", 6).alias("raw_rate"), F.array_join("faults", ",").alias("faults")),
    "SELECT CAST(sum(o_orderkey) AS BIGINT) AS raw, CAST(sum(o_orderkey - o_orderkey % 3) AS BIGINT) AS valid, CAST(sum(o_orderkey // 2) AS BIGINT) AS \"unique\", count(*) AS domains, round(sum(o_orderkey) / 60.0::DOUBLE, 6) AS raw_rate, '' AS faults FROM orders",
)
_add(
    "ev_saturation",
    lambda s, d: S.saturated(_table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("query_family"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("source_class"), F.lit(0).alias("new_valid_urls"), F.lit(0).alias("new_entities"), F.lit(0).alias("new_fields"), (F.col("value") >= 0).alias("mostly_duplicates"))),
    "WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 3) SELECT count(*) = 3 AND bool_and(value >= 0) AND count(DISTINCT event_type) = 3 AND count(DISTINCT user_id) = 3 AS saturated FROM l",
)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as concurrency signals of five backends."""
    v = F.col("value")
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.col("event_id").alias("ord"), F.lit(64).alias("tool_limit"), F.when(F.col("event_id") % 97 == 0, 20).otherwise(64).alias("host_limit"), (F.col("event_id") % 13 == 0).alias("rate_limited"), (F.col("event_id") % 4).cast("int").alias("rate_limit_streak"), F.when(v > 30, 0.2).otherwise(0.0).alias("error_rate"), F.lit(1.0).alias("latency_ratio"), (F.col("event_id") % 3 == 0).alias("window_complete"), (v > 30).cast("int").alias("failed"))


_add("ev_concurrency_fold", lambda s, d: controllers.concurrency(signals(s, d)))
_add("ev_pace_fold", lambda s, d: controllers.pace(_table(s, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_type") == "error", "warning").when(F.col("value") < 1, "empty").otherwise("healthy").alias("outcome"), F.when(F.col("value") > 40, "captcha_required").otherwise("").alias("category"), F.col("value").alias("slow_seconds"))))


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batches of their user's run."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), ((F.col("event_id") % 10) / 20).alias("yield_"))


_add(
    "ev_batch_sizes",
    lambda s, d: controllers.batch_sizes(yields(s, d)),
    """WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS ord, (event_id % 10) / 20.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT run, ord, i, y, 16 AS size FROM e WHERE i = 1 UNION ALL SELECT e.run, e.ord, e.i, e.y, CASE WHEN r.y >= 0.25 THEN least(r.size * 2, 64) WHEN r.y < 0.05 THEN 8 ELSE r.size END FROM r JOIN e ON e.run = r.run AND e.i = r.i + 1)
    SELECT run, ord, size FROM r""",
)
_add(
    "ev_pending_compensation",
    lambda s, d: controllers.pending_compensation(_table(s, d, "events").where("event_type = 'error'").select(F.lit("b").alias("backend"), F.col("user_id").alias("query_id"), F.col("event_id").alias("ord")), _table(s, d, "events").where("event_type = 'purchase' and value > 20").select(F.lit("b").alias("backend"), F.col("user_id").alias("query_id"))),
    "SELECT 'b' AS backend, user_id AS query_id, min(event_id) AS ord FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20) GROUP BY user_id",
)
_add(
    "ev_campaign_gate",
    lambda s, d: controllers.campaign_gate(_table(s, d, "events").select(F.col("user_id").alias("campaign"), F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("started_at"), (F.col("event_type") == "error").alias("hard_block")), gap=3600, cooldown=86400).select("event_id", "may_start"),
    "SELECT event_id, (l IS NULL OR t - l >= 3600) AND (b IS NULL OR t - b >= 86400) AS may_start FROM (SELECT *, max(t) OVER w AS l, max(CASE WHEN event_type = 'error' THEN t END) OVER w AS b FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
)
_add(
    "conv_protocol_faults",
    lambda s, d: ingest.protocol_faults(_table(s, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "summary").when(F.col("role") == "user", "url").otherwise(F.col("role")).alias("type"))),
    "SELECT * FROM (SELECT conv_id AS batch_id, CASE WHEN count(*) FILTER (role NOT IN ('assistant', 'user')) > 0 THEN 'unknown event' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'no summary' WHEN count(*) FILTER (role = 'assistant') > 1 THEN 'several summaries' WHEN max(turn) FILTER (role = 'assistant') <> max(turn) THEN 'events after the summary' END AS fault FROM conversations GROUP BY conv_id) WHERE fault IS NOT NULL",
)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(known).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over the rows at hand gives in the end, written to the shared folder by its sink."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


_add(
    "stream_tumbling_1h",
    lambda s, d: drained(s, windows.tumbling(streamed(s, d), "ts", "value", "1 hour", by=["event_type"]).select(F.unix_seconds("start").alias("hour"), "event_type", "n", F.round("total", 6).alias("total")), "complete"),
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
_add(
    "stream_first_of_key",
    lambda s, d: drained(s, windows.once(streamed(s, d), ["event_id"], "ts").select("event_id", "user_id"), "append"),
    "SELECT event_id, user_id FROM events",
)
_add("stream_concurrency", lambda s, d: drained(s, controllers.concurrency_stream(streamed(s, d).select(F.col("event_type").alias("backend"), F.col("event_id").alias("ord"), F.lit(64).alias("tool_limit"), F.lit(64).alias("host_limit"), F.lit(False).alias("rate_limited"), F.lit(0).alias("rate_limit_streak"), F.when(F.col("value") > 30, 0.2).otherwise(0.0).alias("error_rate"), F.lit(1.0).alias("latency_ratio"), (F.col("event_id") % 3 == 0).alias("window_complete"), F.lit(0).alias("failed"))), "append"))

_add(
    "page_url_exact",
    lambda s, d: _table(s, d, "pages").select("page_id", (urls.canonical_url_exact("url") == urls.canonical_url(F.col("url"))).alias("same"), urls.is_public_url("url").alias("public")),
    "SELECT page_id, true AS same, true AS public FROM pages",
)
_add(
    "part_workspace_classes",
    lambda s, d: validation.workspace(_table(s, d, "part").select(F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.when(F.col("p_partkey") % 5 == 0, "__pycache__").when(F.col("p_partkey") % 5 == 1, "old").when(F.col("p_partkey") % 5 == 2, "src").otherwise("data"), F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 == 0, ".pyc").otherwise(".txt"))).alias("path"), F.col("p_size").alias("size")), ["Brand1"]).groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")),
    "SELECT class, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS size FROM (SELECT p_size, CASE WHEN p_brand = 'Brand#1' THEN 'protected' WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'auto' WHEN p_partkey % 5 = 2 THEN 'protected' WHEN p_partkey % 5 = 1 THEN 'proposal' ELSE 'protected' END AS class FROM part) GROUP BY class",
)
_add(
    "part_bulk_readiness",
    lambda s, d: _table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "search").otherwise("map").alias("source_kind"), F.when(F.col("p_partkey") % 3 == 0, "site").otherwise("open").alias("scope_mode"), (F.col("p_partkey") % 5).alias("valid_sitemaps"), (F.col("p_size") % 2).alias("primary_urls"), (F.col("p_size") * 2.0).alias("raw_rate"), (F.col("p_partkey") % 7 - 3).alias("exhaustive_seeds")).select("p_partkey", validation.bulk_readiness().alias("readiness")),
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN 'bulk_unavailable' WHEN (p_partkey % 3 = 0 AND p_size % 2 > 0) OR p_size * 2 >= 50 OR (p_partkey % 7 - 3 >= 2 AND p_size % 2 > 0) THEN 'bulk_ready' ELSE 'bulk_degraded' END AS readiness FROM part",
)
_add(
    "cust_promotion_audit",
    lambda s, d: validation.promotion(_table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "observed").otherwise("verified").alias("status"), F.when(F.col("c_custkey") % 5 > 0, "effect").alias("expected_effect"), F.when(F.col("c_custkey") % 7 > 0, "test").otherwise(" ").alias("regression_test"), (F.col("c_custkey") % 11 == 0).alias("domain_semantics"), (F.col("c_custkey") % 13 == 0).cast("int").alias("reuse_failures"), F.lit(None).cast("string").alias("promotion"), F.when(F.col("c_custkey") % 2 == 0, "lightweight").otherwise("full").alias("policy"), F.lit(True).alias("auto_apply"), F.lit(True).alias("canonical"))).select("c_custkey", "eligible", "stage", F.size("reasons").alias("reasons"), "allow_auto_apply"),
    """WITH r AS (SELECT c_custkey, c_custkey % 11 = 0 AS dom, c_custkey % 2 = 1 OR c_custkey % 11 = 0 AS fullp, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN (c_custkey % 2 = 1 OR c_custkey % 11 = 0) AND c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN (c_custkey % 2 = 1 OR c_custkey % 11 = 0) AND c_custkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM customer)
    SELECT c_custkey, n = 0 AS eligible, CASE WHEN n = 0 AND NOT fullp THEN 'ready-for-lightweight-permanent-fix' WHEN n = 0 THEN 'ready-for-permanent-fix' ELSE 'temporary' END AS stage, n + CASE WHEN dom THEN 1 ELSE 0 END AS reasons, n = 0 AND NOT dom AS allow_auto_apply FROM r""",
)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as incidents with a symptom that repeats."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.concat(F.lit("Git."), (k % 5).cast("string")).alias("component"), F.concat(F.lit("lock on index, attempt "), k.cast("string")).alias("symptom_signature"), F.when(k % 4 == 0, "verified").otherwise("observed").alias("status"), F.create_map(F.lit("os"), F.when(k % 2 == 0, "linux").otherwise("mac")).alias("environment"), F.lpad(k.cast("string"), 6, "0").alias("last_seen"))


_add(
    "sup_incident_match",
    lambda s, d: registry.match(incidents(s, d), s.createDataFrame([("r", "git 3", "Fatal: LOCK on  index, attempt 9", {"os": "linux"})], "request_id string, component string, symptom string, environment map<string,string>")),
    "SELECT 'r' AS request_id, CAST(s_suppkey AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY s_suppkey % 4 = 0 DESC, s_suppkey % 2 = 0 DESC, s_suppkey DESC) AS INT) AS rank FROM supplier WHERE s_suppkey % 5 = 3",
)
_add(
    "sup_incident_ids",
    lambda s, d: incidents(s, d).select("id", registry.component_name(F.col("component")).alias("component"), registry.signature(F.col("symptom_signature")).alias("signature"), registry.incident_id(F.col("component"), F.col("symptom_signature"), registry.scope_json(F.col("environment"))).alias("incident")),
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'git-' || (s_suppkey % 5) AS component, 'lock on index, attempt <n>' AS signature, substr(sha256('git.' || (s_suppkey % 5) || chr(10) || 'lock on index, attempt <n>' || chr(10) || '{"os":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'linux' ELSE 'mac' END || '"}'), 1, 20) AS incident FROM supplier""",
)


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notes: a heading, a link to the next page's note and one to a note that is not there."""
    n = F.col("page_id")
    return _table(spark, sf_dir, "pages").select(F.concat(F.lit("n/"), n.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Page "), n.cast("string"), F.lit("\n[["), (n + 1).cast("string"), F.lit("#Page "), (n + 1 + F.when(n % 10 == 0, 5).otherwise(0)).cast("string"), F.lit("]] `[[code]]` [[gone"), n.cast("string"), F.lit("]]\n")).alias("content"))


_add(
    "page_note_issues",
    lambda s, d: notes.issues(vault(s, d)).select("path", "line", "kind", "target"),
    "SELECT 'n/' || page_id || '.md' AS path, 2 AS line, CASE WHEN page_id + 1 NOT IN (SELECT page_id FROM pages) THEN 'missing-file' WHEN page_id % 10 = 0 THEN 'missing-heading' ELSE 'relocatable-file' END AS kind, (page_id + 1) || '#Page ' || (page_id + 1 + CASE WHEN page_id % 10 = 0 THEN 5 ELSE 0 END) AS target FROM pages UNION ALL SELECT 'n/' || page_id || '.md', 2, 'missing-file', 'gone' || page_id FROM pages",
)
_add(
    "page_note_repair",
    lambda s, d: notes.repaired(vault(s, d)),
    "SELECT 'n/' || page_id || '.md' AS path, '# Page ' || page_id || chr(10) || '[[' || CASE WHEN page_id % 10 > 0 AND page_id + 1 IN (SELECT page_id FROM pages) THEN 'n/' ELSE '' END || (page_id + 1) || '#Page ' || (page_id + 1 + CASE WHEN page_id % 10 = 0 THEN 5 ELSE 0 END) || ']] `[[code]]` [[gone' || page_id || ']]' || chr(10) AS content FROM pages",
)
_add(
    "page_note_sections",
    lambda s, d: notes.sections(vault(s, d)).select("path", "heading", "level", "line"),
    "SELECT 'n/' || page_id || '.md' AS path, 'page ' || page_id AS heading, 1 AS level, 1 AS line FROM pages",
)
