"""Queries over the problem registry, its tables made of customers and suppliers; what changes tables is published as a version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lineage import shared_folder
from plumbline.operators import resolution
from plumbline.sources.versions import Versions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FAMILY = "family_id string, component string, operation string, failure_phase string, error_class string, feature_groups array<array<string>>, any_features array<string>, solution_ids array<string>"
GUARD = "struct<os:array<string>,shell_contains:array<string>,environment_equals:map<string,string>>"
SOLUTION = f"solution_id string, family_id string, catalog_source string, status string, guard {GUARD}, steps array<string>, reuse_success_count long, reuse_failure_count long, source_legacy_ids array<string>"
EVENT = "event_id string, legacy_id string, component string, symptom_signature string, environment map<string,string>, family_id string, confidence string, candidates array<string>, solution_id string, status string, root_cause string, verification string, first_seen string, last_seen string, occurrences long"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession) -> Versions:
    return Versions(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")


def shaped(frame: DataFrame, schema: str, **values: Column) -> DataFrame:
    """Rows of a schema: the given columns, null for the others."""
    kinds = frame.sparkSession.createDataFrame([], schema).schema.fields
    return frame.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _system(key: str) -> Column:
    return F.create_map(F.lit("os"), F.when(F.col(key) % 2 == 0, "linux").otherwise("mac"))


def supplier_registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A family a supplier, with one or two solutions in several states and guards."""
    s, key = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    families = shaped(s, FAMILY, family_id=_said("f", key), component=_said("Comp ", F.col("s_nationkey")), solution_ids=F.array(_said("s", key, "a")))
    state = F.when(key % 4 == 3, "regressed").when(key % 4 == 2, "draft").otherwise("verified")
    guard = F.struct(F.when(key % 3 == 0, F.array(F.lit("Linux"))).alias("os"), F.lit(None).cast("array<string>").alias("shell_contains"), F.lit(None).cast("map<string,string>").alias("environment_equals"))
    one = shaped(s, SOLUTION, solution_id=_said("s", key, "a"), family_id=_said("f", key), status=state, guard=guard)
    other = shaped(s, SOLUTION, solution_id=_said("s", key, "b"), family_id=_said("f", key), status=F.when(key % 5 == 0, "verified").otherwise("retired"), guard=guard)
    return families, one.unionByName(other)


def preflights(spark: SparkSession, sf_dir: str) -> DataFrame:
    families, solutions = supplier_registry(spark, sf_dir)
    n = _table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"))
    key = F.col("c_custkey")
    asked = _table(spark, sf_dir, "customer").join(F.broadcast(n)).join(_table(spark, sf_dir, "supplier"), F.col("s_suppkey") == key % (F.col("n") + 1), "left")
    own = F.when(key % 6 == 0, F.lit(None)).otherwise(_said("f", key % (F.col("n") + 1)))
    requests = asked.select(_said("r", key).alias("request_id"), _said("comp-", F.when(key % 5 == 1, F.col("c_nationkey")).otherwise(F.coalesce("s_nationkey", F.lit(99)))).alias("component"), own.alias("family_id"), _system("c_custkey").alias("environment"))
    joined = lambda ids: F.array_join(ids, ",")
    return resolution.preflight(requests, families, solutions, joined).select("request_id", "action", "solution_id", "family_ids", *[joined(c).alias(c) for c in ("solution_ids", "blocked")], "reuse_required")


QUERIES["cust_preflight"] = preflights
ORACLE_SQL["cust_preflight"] = """
WITH s AS (SELECT s_suppkey AS k, 'f' || s_suppkey AS f, 'comp-' || s_nationkey AS c, s_suppkey % 4 AS q, s_suppkey % 5 = 0 AS b, s_suppkey % 3 = 0 AS guarded, s_nationkey FROM supplier),
own AS (SELECT c, string_agg(f, ',' ORDER BY f) AS fams, list(f) AS fs FROM s GROUP BY c),
sol AS (SELECT f, guarded, array_to_string(list_filter([CASE WHEN q < 2 THEN 's' || k || 'a' END, CASE WHEN b THEN 's' || k || 'b' END], lambda x: x IS NOT NULL), ',') AS good, (q < 2)::INT + b::INT AS n,
               array_to_string(list_filter([CASE WHEN q = 3 THEN 's' || k || 'a' END, CASE WHEN NOT b THEN 's' || k || 'b' END], lambda x: x IS NOT NULL), ',') AS bad FROM s),
r AS (SELECT 'r' || c_custkey AS request_id, c_custkey % 2 = 0 AS linux, 'comp-' || CASE WHEN c_custkey % 5 = 1 THEN c_nationkey ELSE coalesce(s_nationkey, 99) END AS c, CASE WHEN c_custkey % 6 <> 0 THEN 'f' || (c_custkey % (n + 1)) END AS f
      FROM customer, (SELECT max(s_suppkey) AS n FROM supplier) LEFT JOIN s ON s.k = c_custkey % (n + 1)),
a AS (SELECT request_id, CASE WHEN r.f IS NULL AND fams IS NOT NULL THEN 'candidate-families' WHEN r.f IS NULL THEN 'continue-without-runtime-write' WHEN NOT coalesce(list_contains(fs, r.f), false) THEN 'needs-classification'
        WHEN n <> 1 AND bad <> '' THEN 'local-solution-blocked' WHEN n <> 1 THEN 'needs-solution-review' WHEN guarded AND NOT linux THEN 'guard-not-satisfied' ELSE 'use-verified-solution' END AS action, fams, good, bad
      FROM r LEFT JOIN own ON own.c = r.c LEFT JOIN sol ON sol.f = r.f)
SELECT request_id, action, CASE WHEN action IN ('guard-not-satisfied', 'use-verified-solution') THEN good END AS solution_id, CASE WHEN action IN ('candidate-families', 'needs-classification') THEN coalesce(fams, '') ELSE '' END AS family_ids,
       CASE WHEN action IN ('local-solution-blocked', 'needs-solution-review') THEN good ELSE '' END AS solution_ids, CASE WHEN action IN ('local-solution-blocked', 'needs-solution-review') THEN bad ELSE '' END AS blocked, action = 'use-verified-solution' AS reuse_required FROM a
"""


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer reports a problem of its nation's component; suppliers' nations have seen some before."""
    c, key, nation = _table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    segment = F.lower("c_mktsegment")
    symptom = _said(segment, " lock held, attempt ", key)
    requests = c.select(_said("r", key).alias("request_id"), key.alias("ord"), _said("Comp ", nation).alias("component"), symptom.alias("symptom"), F.lit("").alias("named"), *[F.lit("").alias(x) for x in resolution.IDENTITY], _system("c_custkey").alias("environment"), F.lpad(key.cast("string"), 12, "0").alias("at"))
    kinds = c.select("c_nationkey", segment.alias("segment")).distinct()
    named = _said("fam.", nation, ".", F.col("segment"))
    catalog = shaped(kinds.where("c_nationkey % 2 = 0"), FAMILY, family_id=named, component=_said("comp-", nation), feature_groups=F.array(F.array("segment"), F.array(F.lit("lock"))), any_features=F.array(), solution_ids=F.array(F.concat(named, F.lit(".s"))))
    remedies = shaped(kinds.where("c_nationkey % 2 = 0"), SOLUTION, solution_id=F.concat(named, F.lit(".s")), family_id=named, status=F.when(nation % 3 == 0, "verified").otherwise("draft"))
    s = _table(spark, sf_dir, "supplier").select("s_nationkey").distinct().crossJoin(F.broadcast(c.select(segment.alias("segment")).distinct().orderBy("segment").limit(1)))
    seen = shaped(s, EVENT, event_id=_said("old.", F.col("s_nationkey")), legacy_id=_said("l.", F.col("s_nationkey")), component=_said("comp-", F.col("s_nationkey")), symptom_signature=_said(F.col("segment"), " lock held, attempt <n>"), environment=F.create_map(F.lit("os"), F.lit("mac")), family_id=F.lit("unclassified.x"), confidence=F.lit("old"), candidates=F.array(), status=F.lit("observed"), first_seen=F.lit("0"), last_seen=F.lit("0"), occurrences=F.lit(5))
    store = _store(spark)
    store.publish({"families": spark.createDataFrame([], FAMILY), "solutions": spark.createDataFrame([], SOLUTION), "events": seen})
    now = resolution.capture(*(store.read(t) for t in ("families", "solutions", "events")), requests, catalog, remedies)
    store.publish(now, check=resolution.consistent)
    store.clean(1)
    return store.read("events").select("event_id", "component", "symptom_signature", "family_id", "confidence", "solution_id", "first_seen", "last_seen", "occurrences")


QUERIES["cust_capture"] = captured
ORACLE_SQL["cust_capture"] = """
WITH r AS (SELECT c_nationkey AS n, lower(c_mktsegment) AS seg, CASE WHEN c_custkey % 2 = 0 THEN 'linux' ELSE 'mac' END AS os, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS spot FROM customer),
g AS (SELECT n, seg, os, min(spot) AS a, max(spot) AS b, count(*) AS times FROM r GROUP BY ALL),
old AS (SELECT DISTINCT s_nationkey AS n, (SELECT min(lower(c_mktsegment)) FROM customer) AS seg, 'mac' AS os FROM supplier),
j AS (SELECT coalesce(g.n, old.n) AS n, coalesce(g.seg, old.seg) AS seg, coalesce(g.os, old.os) AS os, a, b, coalesce(times, 0) AS times, old.n IS NOT NULL AS known, g.n IS NOT NULL AS here FROM g FULL JOIN old ON g.n = old.n AND g.seg = old.seg AND g.os = old.os),
k AS (SELECT *, 'comp-' || n AS c, seg || ' lock held, attempt <n>' AS sig, n % 2 = 0 AND here AS hit FROM j)
SELECT CASE WHEN known THEN 'old.' || n ELSE 'event.' || substr(sha256(c || chr(31) || sig || chr(31) || '{"os":"' || os || '"}'), 1, 16) END AS event_id, c AS component, sig AS symptom_signature,
       CASE WHEN hit THEN 'fam.' || n || '.' || seg WHEN known THEN 'unclassified.x' ELSE 'unclassified.' || c || '.' || substr(sha256(c || chr(31) || sig), 1, 16) END AS family_id,
       CASE WHEN hit THEN 'rule-exact' WHEN here THEN 'unclassified' ELSE 'old' END AS confidence, CASE WHEN hit AND n % 3 = 0 THEN 'fam.' || n || '.' || seg || '.s' END AS solution_id,
       CASE WHEN known THEN '0' ELSE a END AS first_seen, CASE WHEN here THEN b ELSE '0' END AS last_seen, CAST(times + CASE WHEN known THEN 5 ELSE 0 END AS BIGINT) AS occurrences
FROM k
"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's event is resolved into its nation's and segment's family, unless something speaks against it."""
    c, key, nation, segment = _table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey"), F.lower("c_mktsegment")
    events = shaped(c, EVENT, event_id=_said("e", key), legacy_id=_said("l", key), component=_said("comp-", nation), symptom_signature=F.lit("x"), environment=_system("c_custkey"), family_id=F.lit("unclassified.x"), candidates=F.array(), status=F.lit("observed"), first_seen=F.lit("0"), last_seen=F.lit("0"), occurrences=F.lit(1))
    families = shaped(c.select("c_nationkey").distinct(), FAMILY, family_id=_said("taken.", nation), component=_said("comp-", nation), operation=F.lit("taken"), failure_phase=F.lit("run"), error_class=F.lit("e"), feature_groups=F.array(), any_features=F.array(), solution_ids=F.array())
    reserved = shaped(c.select("c_nationkey").distinct(), SOLUTION, solution_id=_said("reserved.", nation), family_id=_said("elsewhere.", nation), status=F.lit("verified"))
    family = F.when(key % 13 == 0, _said("taken.", (nation + 1) % 25)).otherwise(_said("fam.", nation, ".", segment))
    requests = c.select(
        _said("r", key).alias("request_id"), key.alias("ord"), F.when(key % 2 == 0, _said("e", key)).when(key % 17 == 0, F.lit("nobody")).otherwise(_said("l", key)).alias("event_id"), family.alias("family_id"),
        F.when(key % 19 == 0, _said("reserved.", nation)).otherwise(_said("sol.", nation, ".", segment, ".", key % 3)).alias("solution_id"), F.when(key % 11 == 0, "taken").otherwise(segment).alias("operation"), F.lit("run").alias("failure_phase"), F.lit("e").alias("error_class"),
        F.lit("cause").alias("root_cause"), F.when(key % 7 == 0, " ").otherwise("seen to work").alias("verification"), F.array(F.when(key % 23 == 0, " ").otherwise("step")).alias("steps"), F.lit(None).cast(GUARD).alias("guard"),
        F.lit("works").alias("expected_effect"), (key % 29 == 0).alias("domain_semantics"), F.lit(None).cast("string").alias("regression_test"), F.lpad(key.cast("string"), 12, "0").alias("at"),
    )
    store = _store(spark)
    store.publish({"families": families, "solutions": spark.createDataFrame([], SOLUTION), "events": events})
    now = resolution.resolve(*(store.read(t) for t in ("families", "solutions", "events")), requests, spark.createDataFrame([], FAMILY), reserved)
    store.publish(now, check=resolution.consistent)
    store.clean(1)
    event = store.read("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "family_id", "solution_id", F.concat_ws(",", "status", "confidence", "last_seen").alias("detail"))
    solution = store.read("solutions").select(F.lit("solution").alias("kind"), F.col("solution_id").alias("id"), "family_id", "solution_id", F.size("source_legacy_ids").cast("string").alias("detail"))
    owner = store.read("families").select(F.lit("family").alias("kind"), F.col("family_id").alias("id"), "family_id", F.lit(None).cast("string").alias("solution_id"), F.concat_ws(",", "component", "operation", F.array_join("solution_ids", "+")).alias("detail"))
    refused = store.read("faults").select(F.lit("fault").alias("kind"), F.col("request_id").alias("id"), F.lit(None).cast("string").alias("family_id"), F.lit(None).cast("string").alias("solution_id"), F.col("fault").alias("detail"))
    return event.unionByName(solution).unionByName(owner).unionByName(refused)


QUERIES["cust_resolve"] = resolved
ORACLE_SQL["cust_resolve"] = """
WITH r AS (SELECT c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS seg, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS spot, CASE WHEN c_custkey % 13 = 0 THEN 'taken.' || (c_nationkey + 1) % 25 ELSE 'fam.' || c_nationkey || '.' || lower(c_mktsegment) END AS fam,
        CASE WHEN c_custkey % 11 = 0 THEN 'taken' ELSE lower(c_mktsegment) END AS op, 'sol.' || c_nationkey || '.' || lower(c_mktsegment) || '.' || c_custkey % 3 AS sol FROM customer),
f AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'a field is empty' WHEN k % 23 = 0 THEN 'no steps' WHEN k % 29 = 0 THEN 'no regression test' WHEN k % 2 = 1 AND k % 17 = 0 THEN 'unknown event'
        WHEN op = 'taken' THEN 'identity belongs to another family' WHEN k % 19 = 0 THEN 'solution is reserved by the catalog' WHEN k % 13 = 0 AND (n + 1) % 25 IN (SELECT c_nationkey FROM customer) THEN 'family of another component' END AS fault FROM r),
good AS (SELECT * FROM f WHERE fault IS NULL)
SELECT 'event' AS kind, 'e' || k AS id, CASE WHEN fault IS NULL THEN fam ELSE 'unclassified.x' END AS family_id, CASE WHEN fault IS NULL THEN sol END AS solution_id, CASE WHEN fault IS NULL THEN 'verified,explicit,' || spot ELSE 'observed,0' END AS detail FROM f
UNION ALL SELECT 'solution', sol, max_by(fam, k), sol, CAST(count(*) AS VARCHAR) FROM good GROUP BY sol
UNION ALL SELECT 'family', fam, fam, NULL, 'comp-' || n || ',' || op || ',' || string_agg(DISTINCT sol, '+' ORDER BY sol) FROM good GROUP BY fam, n, op
UNION ALL SELECT DISTINCT 'family', 'taken.' || n, 'taken.' || n, NULL, 'comp-' || n || ',taken,' FROM r
UNION ALL SELECT 'fault', 'r' || k, NULL, NULL, fault FROM f WHERE fault IS NOT NULL
"""
