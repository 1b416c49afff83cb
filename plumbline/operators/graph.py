"""Graph operators over edge tables: reachability, closures, order and states.

Recursion runs inside one SQL query, with the depth carried along so that cycles end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.lineage import cut


def passes(most: int | None) -> Iterator[int]:
    """Numbers for a loop that ends once nothing is added; to need more than most (None: no bound) is an error."""
    for n in count():
        if n == most:
            raise RuntimeError(f"not done after {most} passes")
        yield n


#: Most tables of which a growing one is made before they are written as one.
LAYERS = 16


def _layered(layers: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """The tables with one more; many become one, so that neither a plan nor what is written again grows with each pass."""
    layers = [*layers, new]
    return layers if len(layers) < LAYERS else [cut(reduce(DataFrame.unionByName, layers))]


def _recursive(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    spark, mark = edges.sparkSession, uuid.uuid4().hex
    edges.select("src", "dst").createOrReplaceTempView(f"edges_{mark}")
    seeds.select("node").createOrReplaceTempView(f"seeds_{mark}")
    return spark.sql(f"""
        WITH RECURSIVE reach (node, depth) MAX RECURSION LEVEL {depth + 1} AS (
          SELECT node, 0 FROM seeds_{mark}
          UNION ALL
          SELECT e.dst, r.depth + 1 FROM reach r JOIN edges_{mark} e ON e.src = r.node WHERE r.depth < {depth}
        )
        SELECT node, min(depth) AS depth FROM reach GROUP BY node""")


def reachable(edges: DataFrame, seeds: list | DataFrame, depth: int = 50) -> DataFrame:
    """node and least depth of all that the seeds reach over (src, dst) edges in at most `depth` steps, seeds included.

    Paths are walked, not nodes, so this is for graphs of few paths (trees, dependency graphs). closure() is for others.
    """
    if not isinstance(seeds, DataFrame):
        seeds = edges.sparkSession.createDataFrame([(s,) for s in seeds], "node string")
    return _recursive(edges, seeds, depth)


def steps_from(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and depth, its fewest steps from a seed, of all nodes within `depth` steps; cycles do no harm."""
    step = cut(edges.select("src", "dst"))
    found = frontier = cut(seeds.select("node", F.lit(0).alias("depth")).distinct())
    for at in range(1, depth + 1):
        new = cut(frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(at)))
        if new.isEmpty():
            break
        found, frontier = cut(found.unionByName(new)), new
    return found


def closure(edges: DataFrame, seeds: DataFrame, *, both_ways: bool = False, depth: int | None = None) -> DataFrame:
    """The nodes that the seeds reach, cycles or not: a frontier grows by one step a pass until it adds nothing.

    depth: passes after which to raise an error if nodes are still added. Joins are by sorting: frontiers grow with the graph,
    and the driver would hold one of each pass.
    """
    step = edges.select("src", "dst")
    if both_ways:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    step = cut(step)
    frontier = cut(seeds.select("node").distinct())
    layers = [frontier]
    for _ in passes(depth):
        found = reduce(DataFrame.unionByName, layers)
        new = cut(frontier.join(step.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found.hint("merge"), "node", "left_anti"))
        if new.isEmpty():
            break
        layers, frontier = _layered(layers, new), new
    return reduce(DataFrame.unionByName, layers)


def affected(requirements: DataFrame, changed: DataFrame) -> DataFrame:
    """Requirements downstream of changed ones. requirements: id, requires (array); changed: node."""
    return closure(requirement_edges(requirements), changed)


def requirement_edges(components: DataFrame, id_col: str = "id", requires: str = "requires") -> DataFrame:
    """(src, dst): what is required, and by whom."""
    return components.select(F.explode(requires).alias("src"), F.col(id_col).alias("dst"))


def audit_scope(components: DataFrame, changed: DataFrame) -> DataFrame:
    """Providers and consumers, near and far, of changed components."""
    edges = requirement_edges(components)
    up = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed)
    return up.unionByName(closure(edges, changed)).distinct()


def dependency_order(components: DataFrame, depth: int | None = None) -> DataFrame:
    """id and rank: every component after what it requires (rank is the longest way to a root; ties by id).

    depth: passes after which to raise an error if components are still ranked. A component on or behind a cycle has no rank, nor has one that requires what is not there; problem says which.
    """
    edges = requirement_edges(components)
    known = components.select(F.col("id").alias("node"))
    missing = edges.join(known.hint("merge"), edges["src"] == known["node"], "left_anti").select(F.col("dst").alias("node")).distinct()
    broken = closure(edges, missing).withColumnRenamed("node", "id").withColumn("problem", F.lit("missing dependency"))
    # A pass takes what became ready in the one before to those that need it; only these are counted, and ready once all needs came.
    waiting = edges.join(broken.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti")
    waiting = cut(waiting.withColumn("needs", F.count(F.lit(1)).over(Window.partitionBy("dst"))))
    ready = cut(components.where(F.size("requires") == 0).select("id"))
    layers, partly = [ready.withColumn("rank", F.lit(0))], None
    for n in passes(depth):
        came = ready.distinct().join(waiting.hint("merge"), F.col("id") == F.col("src")).groupBy("dst").agg(F.count(F.lit(1)).alias("came"), F.max("needs").alias("needs"))
        if partly is not None:
            came = partly.unionByName(came).groupBy("dst").agg(F.sum("came").alias("came"), F.max("needs").alias("needs"))
        came = cut(came)
        ready, partly = came.where("came = needs").select(F.col("dst").alias("id")), came.where("came < needs")
        if ready.isEmpty():
            break
        layers = _layered(layers, ready.withColumn("rank", F.lit(n + 1)))
    done = reduce(DataFrame.unionByName, layers)
    rest = components.select("id").join(done.select("id").hint("merge"), "id", "left_anti").join(broken.select("id").hint("merge"), "id", "left_anti").withColumn("problem", F.lit("cycle"))
    return done.withColumn("problem", F.lit(None).cast("string")).unionByName(broken.unionByName(rest).withColumn("rank", F.lit(None).cast("int")), allowMissingColumns=True)


def verified_states(requirements: DataFrame) -> DataFrame:
    """id and state: `verified` only if a requirement and all that it rests on are; on a cycle it stays `pending`.

    requirements: id, requires, own (whether its own evidence holds).
    """
    edges = requirement_edges(requirements)
    open_ = requirements.where(~F.col("own")).select(F.col("id").alias("node"))
    order = dependency_order(requirements)
    stuck = order.where(F.col("problem").isNotNull()).select(F.col("id").alias("node"))
    pending = closure(edges, open_.unionByName(stuck).distinct()).select(F.col("node").alias("id"), F.lit(True).alias("late"))
    return requirements.join(pending.hint("merge"), "id", "left").select("id", F.when(F.col("late"), "pending").otherwise("verified").alias("state"))


def mentioned_files(files: DataFrame, roots: list[str], depth: int | None = None) -> DataFrame:
    """Files that the roots reach by naming one another. files: path, content; a mention is the file's name as a word of the text."""
    name = F.substring_index("path", "/", -1)
    words = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w.-]+"), 0))).alias("word"))
    targets = files.select(F.col("path").alias("dst"), name.alias("word"))
    edges = words.join(targets, "word").where("src != dst").select("src", "dst").distinct()
    seeds = files.where(F.col("path").isin(*roots)).select(F.col("path").alias("node"))
    return closure(edges, seeds, depth=depth)


def invalidate(evidence: DataFrame, requirements: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence that still holds after paths changed, and that which no longer does, down to what rests on it.

    evidence: id, requirement, path; requirements: id, requires; changed: path.
    """
    direct = evidence.join(changed.select("path"), "path", "left_semi")
    touched = closure(requirement_edges(requirements), direct.select(F.col("requirement").alias("node")).distinct())
    stale = evidence.join(touched.select(F.col("node").alias("requirement")).hint("merge"), "requirement", "left_semi")
    return evidence.join(stale.select("id"), "id", "left_anti"), stale


def complete_upward(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and complete: whether a node and all that it names, at any depth, are there and whole. nodes: node, whole; edges: parent, child.

    What is not whole, and what names a child that is not there, makes all that name it incomplete, and so on upward. Nodes of
    a cycle depend on each other; nothing but a fault makes them incomplete.
    """
    gone = edges.join(nodes.select(F.col("node").alias("child")), "child", "left_anti").select(F.col("parent").alias("node"))
    faulty = nodes.where(~F.col("whole")).select("node").unionByName(gone).distinct()
    reached = closure(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), faulty)
    return nodes.join(reached.select("node", F.lit(True).alias("__late")), "node", "left").select("node", F.col("__late").isNull().alias("complete"))
