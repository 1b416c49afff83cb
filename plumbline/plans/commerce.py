"""Queries over the star schema: rankings, upserts, evidence, products and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evidence, graph, joins, ledger, ranking, upserts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_add(
    "ord_topk_diverse",
    lambda s, d: ranking.diverse_top(_table(s, d, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 12).select("o_orderkey", "o_orderpriority", "o_totalprice", "place"),
    "SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) ORDER BY CASE WHEN place = 1 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 12",
)


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as directions: their balance and key make the dimensions and states."""
    c = _table(spark, sf_dir, "customer")
    names = list(ranking.WEIGHTS)
    values = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.pmod(F.floor("c_acctbal") + i * F.col("c_custkey"), F.lit(6)).cast("double"))])
    return c.select(F.col("c_name").alias("name"), values.alias("dimensions"), (F.col("c_nationkey") % 2 == 0).alias("hard_gate"), F.when(F.col("c_custkey") % 5 == 0, "over_budget").when(F.col("c_custkey") % 5 == 1, "unknown").otherwise("ok").alias("training_budget_status"), F.lit("measured").alias("deployment_status"), (F.col("c_custkey") % 7 == 0).alias("generic_topic"))


_WEIGHED = " + ".join(f"((floor(c_acctbal)::BIGINT + {i} * c_custkey) % 6 + 6) % 6 * {w}::DOUBLE" for i, w in enumerate(ranking.WEIGHTS.values()))
_add(
    "ord_topk_scored",
    lambda s, d: ranking.rank_directions(directions(s, d)).select("name", "score", "preference"),
    f"SELECT c_name AS name, round({_WEIGHED}, 2) AS score, CASE WHEN c_custkey % 5 = 1 THEN 'pending' ELSE 'passed' END AS preference FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 ORDER BY 2 DESC, 1 LIMIT 15",
)
_add(
    "ord_upsert_latest",
    lambda s, d: upserts.upsert(_table(s, d, "orders").select((2 * F.col("o_custkey")).alias("k"), F.lit("old").alias("status"), F.lit(0.0).alias("price")).dropDuplicates(["k"]), _table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ord")), ["k"], "ord"),
    "WITH n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) SELECT * FROM n UNION ALL SELECT DISTINCT 2 * o_custkey, 'old', 0.0::DOUBLE FROM orders WHERE 2 * o_custkey NOT IN (SELECT k FROM n)",
)
_add(
    "ord_insert_ignore",
    lambda s, d: upserts.insert_or_ignore(_table(s, d, "orders").groupBy((3 * F.col("o_custkey")).alias("k")).agg((-F.min("o_orderkey")).alias("first")), _table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first")), ["k"], "first"),
    "SELECT 3 * o_custkey AS k, -min(o_orderkey) AS first FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT 3 * o_custkey FROM orders) GROUP BY 1",
)
_add(
    "ord_delete_audit",
    lambda s, d: upserts.delete_with_audit(_table(s, d, "orders").select("o_orderkey"), _table(s, d, "orders").select((F.col("o_orderkey") * 7).alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence")), "o_orderkey")[1].groupBy("found").agg(F.count(F.lit(1)).alias("n")),
    "SELECT a.o_orderkey * 7 IN (SELECT o_orderkey FROM orders) AS found, count(*) AS n FROM orders a WHERE a.o_orderkey % 2 = 0 GROUP BY 1",
)
_add(
    "ord_family_counts",
    lambda s, d: ledger.family_counts(
        _table(s, d, "lineitem").select(F.col("l_orderkey").alias("last_batch_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("query_family"), F.when(F.col("l_linenumber") == 1, "exhausted").when(F.col("l_linenumber") == 2, "blocked").otherwise("open").alias("status"), F.col("l_quantity").cast("long").alias("unique_candidate_additions")),
        _table(s, d, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderstatus") != "P").alias("complete")),
    ),
    "SELECT l_returnflag AS source, l_linestatus AS query_family, count(*) AS cursors, count(*) FILTER (l_linenumber = 1) AS exhausted, count(*) FILTER (l_linenumber = 2) AS blocked, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2",
)
_add(
    "ord_channel_counts",
    lambda s, d: ledger.channel_counts(_table(s, d, "lineitem").select(F.col("l_orderkey").alias("url_id"), F.col("l_suppkey").alias("platform"), F.col("l_partkey").alias("product_id")), _table(s, d, "orders").select(F.col("o_orderkey").alias("url_id"), F.col("o_orderpriority").alias("channel"))),
    "SELECT o_orderpriority AS channel, count(DISTINCT (l_suppkey, l_partkey)) AS candidates FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
)
_add(
    "li_evidence_eav",
    lambda s, d: evidence.fields_by_entity(_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_returnflag"]).groupBy("field").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("atoms")).alias("atoms")),
    "SELECT field, count(DISTINCT (l_orderkey, l_linenumber)) AS entities, count(*) AS atoms FROM lineitem, (SELECT unnest(['l_quantity', 'l_discount', 'l_returnflag']) AS field) GROUP BY field",
)
_add(
    "li_failure_recovery",
    lambda s, d: ledger.recovery_summary(_table(s, d, "lineitem").select(F.get(F.array(*map(F.lit, ledger.DISPOSITIONS)), (F.col("l_partkey") % 11).cast("int")).alias("category"), F.col("l_returnflag").alias("query_family"))),
    f"""WITH m AS (SELECT unnest([{", ".join(f"{{i: {i}, c: '{c}', d: '{v}'}}" for i, (c, v) in enumerate(ledger.DISPOSITIONS.items()))}]) AS x), f AS (SELECT x.d AS disposition, l_returnflag AS query_family, x.c AS category FROM lineitem JOIN m ON x.i = l_partkey % 11) SELECT disposition, query_family, category, count(*) AS n FROM f GROUP BY ROLLUP (disposition, query_family, category)""",
)


#: Most values of an axis, all of which the driver holds; more are an error.
AXIS_VALUES = 10_000


def axis(table: DataFrame, name: str, most: int = AXIS_VALUES) -> list[str]:
    """The distinct values of a column, in order."""
    found = [str(r[0]) for r in table.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"axis {name} has more than {most} values")
    return found


def axes(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Distinct brands, types and sizes: three short lists."""
    part = _table(spark, sf_dir, "part")
    values = lambda c: axis(part, c)
    return {"brand": values("p_brand"), "kind": values("p_type"), "size": values("p_size")}


_add(
    "part_product_decode",
    lambda s, d: ranking.cursors(ranking.product(s, axes(s, d)).withColumn("query", ranking.query_text([F.col("brand"), F.col("kind"), F.col("size")])), "brand", "query"),
    "WITH b AS (SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)), k AS (SELECT p_type AS kind, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)), z AS (SELECT CAST(p_size AS VARCHAR) AS size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)) SELECT (b.i * k.n + k.i) * z.n + z.i AS ordinal, brand, kind, size, brand || ' ' || kind || ' ' || size AS query, brand || ':' || substr(sha256(brand || chr(0) || CAST((b.i * k.n + k.i) * z.n + z.i AS VARCHAR) || chr(0) || brand || ' ' || kind || ' ' || size), 1, 20) AS cursor_id FROM b, k, z",
)
_add(
    "part_query_matrix",
    lambda s, d: ranking.query_matrix(s, {"brand": axes(s, d)["brand"], "empty": [], "kind": axes(s, d)["kind"]}, ["used"]).select("query"),
    "SELECT DISTINCT p_brand || ' ' || t || ' -used' AS query FROM part, (SELECT DISTINCT p_type AS t FROM part)",
)
_add(
    "part_fair_order",
    lambda s, d: ranking.fair_order(_table(s, d, "part"), ["p_brand"], [F.col("p_partkey")]).select("p_partkey", "turn"),
    "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS turn FROM part",
)
_add(
    "part_nice_ceiling",
    lambda s, d: _table(s, d, "part").select("p_partkey", ranking.nice_ceiling(F.col("p_partkey") * 13).alias("top")),
    "SELECT p_partkey, CASE WHEN p_partkey * 13 <= 0 THEN 1 ELSE CAST(list_min(list_filter(list_transform([1, 2, 4, 5, 8, 10], lambda f: f * pow(10, floor(log10(p_partkey * 13)))), lambda x: x >= p_partkey * 13)) AS BIGINT) END AS top FROM (SELECT * FROM part WHERE p_partkey > 0) UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey <= 0",
)


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer, and nations in a ring of their own region."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst")).unionByName(customer.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))).unionByName(nation.select(node("n", "n_nationkey").alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 5) % 25).cast("string")).alias("dst")))


_EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 5) % 25) FROM nation)"
_add(
    "geo_dependency_closure",
    lambda s, d: graph.closure(geo_edges(s, d), s.createDataFrame([("n3",)], "node string")),
    f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'n3' AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
)
_add(
    "geo_reachable_depth",
    lambda s, d: graph.reachable(geo_edges(s, d).where("not (src like 'n%' and dst like 'n%')"), ["r1"], 5),
    "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), r AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node",
)


def every_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that need parts of smaller key: k needs k // 2 and k // 3."""
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(k.cast("string").alias("id"), F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")))).alias("requires"), (k % 17 != 4).alias("own"))


_add(
    "part_dependency_order",
    lambda s, d: graph.dependency_order(every_component(s, d)).select("id", "rank", "problem"),
    "WITH RECURSIVE r AS (SELECT 0::BIGINT AS id, 0 AS rank UNION SELECT p_partkey, rank + 1 FROM r JOIN part ON p_partkey > 0 AND (p_partkey // 2 = r.id OR p_partkey // 3 = r.id)) SELECT CAST(id AS VARCHAR) AS id, max(rank) AS rank, CAST(NULL AS VARCHAR) AS problem FROM r GROUP BY id",
)
_add(
    "part_verified_states",
    lambda s, d: graph.verified_states(every_component(s, d)),
    "WITH RECURSIVE r AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 17 = 4 UNION SELECT p_partkey FROM r JOIN part ON p_partkey > 0 AND (p_partkey // 2 = r.id OR p_partkey // 3 = r.id)) SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey IN (SELECT id FROM r) THEN 'pending' ELSE 'verified' END AS state FROM part",
)
_add(
    "supplier_match_any",
    lambda s, d: joins.match_any(_table(s, d, "supplier").select("s_suppkey", F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("b"), F.floor("s_acctbal").cast("string"))).alias("keys")), _table(s, d, "nation").select("n_nationkey", F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("b"), (F.col("n_nationkey") + 70).cast("string"))).alias("keys")), "keys", "keys", "s_suppkey", "n_nationkey"),
    "SELECT s_suppkey AS left_id, n_nationkey AS right_id FROM supplier JOIN nation ON s_nationkey = n_nationkey OR floor(s_acctbal) = n_nationkey + 70",
)
