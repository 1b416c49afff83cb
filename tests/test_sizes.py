"""Registered queries against their SQL on tables whose keys and texts the small ones lack, and bounds that hold at any size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence, graph, registry, resolution, scan, validation
from plumbline.plans import catalog
from plumbline.sources import pages
from tests.oracle import compare

AT = "/root/testdata/sf0.01"


@pytest.fixture
def tables(tmp_path):
    """A folder of the small tables; table(name, sql) puts another in the place of one."""
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{AT}/{t}.parquet")

    def table(name, sql):
        (tmp_path / f"{name}.parquet").unlink()
        duckdb.sql(f"copy ({sql.format(old=f'{AT}/{name}.parquet')}) to '{tmp_path}/{name}.parquet'")
        return str(tmp_path)

    return table


def equal(spark, name, at):
    return compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], at)


def test_page_titles_with_references(spark, tables):
    at = tables("pages", "select * replace (replace(html, '<title>', '<title>&quot;a&lt;b&quot; &amp;amp; &#39;') as html) from '{old}'")
    assert equal(spark, "page_title_extract", at) == 250
    assert spark.sql("select '<title> &quot;a&amp;lt;&lt;</title>' as h").select(pages.title(F.col("h")).alias("t")).first().t == '"a&lt;<'


def test_image_numbers_of_seven_digits(spark, tables):
    at = tables("part", "select i as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from range(1000100) r(i), (from '{old}' limit 1)")
    assert equal(spark, "part_image_faults", at) > 10_000


def test_sort_keys_beyond_their_width(spark, tables):
    at = tables("part", "select * replace (p_partkey * 997 as p_partkey) from '{old}'")
    assert equal(spark, "part_sort_index", at) == 2000
    assert spark.range(1).select(validation.sort_index(F.lit(3), F.lit(42), F.lit(123456)).alias("x")).first().x == "00003|000042|123456"


def rows_met(frame):
    """The most rows that a join of the query gave."""
    frame.collect()
    most = -1

    def walk(node):
        nonlocal most
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            walk(node.plan())
        if "Join" in kind:
            metric = node.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    assert most >= 0
    return most


def test_one_title_for_all_items(spark, tables):
    at = tables("part", "select * replace ('one title' as p_name) from '{old}'")
    assert equal(spark, "part_library_alignment", at) == 2000
    assert rows_met(catalog.QUERIES["part_library_alignment"](spark, at)) <= 3 * 2000


def test_one_family_for_all_solutions(spark, tables):
    tables("supplier", "select * replace (7 as s_nationkey) from '{old}'")
    at = tables("customer", "select * replace (7 as c_nationkey) from '{old}'")
    assert equal(spark, "cust_closure_report", at) == 1500
    assert rows_met(catalog.QUERIES["cust_closure_report"](spark, at)) <= 2 * 1500


def test_rules_of_distinct_names_return_without_the_driver(spark):
    rows = spark.range(200).selectExpr("id as k", "concat('eco', id % 3) as component")
    rules = spark.createDataFrame([("eco1", "one", 0), ("eco", "some", 1)], "prefix string, value string, ord int")
    found = registry.canonical_components(rows, spark.createDataFrame([("eco2", "two")], "name string, value string"), rules)
    assert {(r.component, r.canonical) for r in found.collect()} == {("eco0", "some"), ("eco1", "one"), ("eco2", "two")} and found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "SortMergeJoin" in plan


def test_long_chains_without_the_driver(spark, monkeypatch):
    """A chain of more passes than a plan has layers; steps send no side of a join through the driver."""
    plans, cut = [], graph.cut

    def seen(frame):
        out = cut(frame)
        frame.collect()
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "cut", seen)
    monkeypatch.setattr(graph, "LAYERS", 3)
    chain = spark.createDataFrame([("0", []), *[(str(i), [str(i - 1), str(i // 2)]) for i in range(1, 7)]], "id string, requires array<string>")
    assert sorted((r.id, r.rank, r.problem) for r in graph.dependency_order(chain).collect()) == [(str(i), i, None) for i in range(7)]
    assert sorted(r.node for r in graph.affected(chain, spark.createDataFrame([("3",)], "node string")).collect()) == ["3", "4", "5", "6"]
    assert not any("BroadcastExchange" in p for p in plans)


def test_notice_makes_a_signature_once(spark):
    made = spark.range(1).select(registry.notice(F.lit("x"), F.col("id").cast("string")))
    assert made._jdf.queryExecution().analyzed().toJSON().count("expressions.RegExpReplace") == 6


def test_fields_are_moved_with_their_row(spark):
    rows = spark.createDataFrame([(1, 1, 2.5, None), (1, 1, 1.0, "b"), (1, 2, 3.0, "c"), (None, 3, None, "d")], "a long, b long, x double, y string")
    held = evidence.fields_by_entity(rows, ["a", "b"], ["x", "y"])
    want = evidence.by_entity(evidence.atoms(rows, ["a", "b"], ["x", "y"]))
    assert sorted(map(str, held.collect())) == sorted(map(str, want.collect()))


def test_boxes_are_dealt_by_count(spark, monkeypatch):
    assert scan.dealt(spark.range(1000), "id", task_rows=10).rdd.getNumPartitions() == 100
    frame = catalog.QUERIES["li_merge_boxes"](spark, AT)
    frame.collect()
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1



def test_lists_of_one_component_are_dealt(spark, tables, monkeypatch):
    """Requests that hold a component's list of families are cut into parts, though all are of one component."""
    monkeypatch.setattr(resolution, "LIST_ROWS", 50, raising=False)
    tables("supplier", "select * replace (7 as s_nationkey) from '{old}'")
    at = tables("customer", "select * replace (7 as c_nationkey) from '{old}'")
    assert equal(spark, "cust_preflight", at) == 1500
    listed = catalog.QUERIES["cust_preflight"](spark, at).where("family_ids <> ''")
    sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) >= 250 and max(sizes) <= 100
