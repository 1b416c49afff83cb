"""Approximate nearest neighbours by multiprobe p-stable hashing with exact distances.

A table has HASHES(n) projections on Gaussian directions, cut into cells of equal width; their cells together are a
bucket. A query visits the buckets around its own in the order of their estimated success: the chance that a neighbour at
the usual distance of the wanted rank falls there, given where the query lies in its cells. It goes on until the tables
together reach the wanted recall. Each bucket gives its nearest vectors by exact distance, and the tables' are merged.

The usual distance is measured: SAMPLE query vectors against all vectors. Nothing else is fitted. Every vector is indexed.

Buckets are dealt out in groups of at most GROUP_ROWS vectors, so that a hot bucket is many tasks; a task holds the queries
of one group and passes over its vectors in batches. Queries with equal vectors are searched once. Ties go to smaller ids.
Queries that find fewer than k vectors are searched again against all vectors, in blocks of about BLOCK queries.
All joins are by sorting: probes and their groups grow with the vectors, and none of them goes through the driver.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than the most frequent one (the smaller of equals), nor null ids. Rows that repeat an id are one vector, the one
first in order of components. Fewer vectors than k give all. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bounded_batches, table

TABLES = 4
#: Width of a cell, in usual neighbour distances.
WIDTH = 1.5
RECALL = 0.95
SAMPLE = 64
GROUP_ROWS = 4096
BLOCK = 256
SEED = 20240229

FOUND = "qkey long, vec_id long, score double"


def hashes(n: int) -> int:
    """Projections a table: buckets grow in number with the vectors."""
    return min(10, max(2, round(math.log2(max(2, n)) / 3)))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite)
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    return rows.where(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))


class Nearest:
    """The k nearest vectors of each of a set of queries, over batches of vectors; by distance, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = (queries**2).sum(1)
        self.dist = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo("i8").max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, (1 << 22) // max(1, len(ids)))
        for at in range(0, len(self.queries), step):
            part = slice(at, at + step)
            rough = self.squares[part, None] + (vectors**2).sum(1)[None] - 2 * self.queries[part] @ vectors.T
            slack = 1e-9 * (1 + self.squares[part, None])
            bound = self.dist[part, -1:] ** 2
            if len(ids) > self.k:
                bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            rows, cols = np.nonzero(rough <= bound + slack)
            exact = np.sqrt(((self.queries[part][rows] - vectors[cols]) ** 2).sum(1)) if len(rows) else np.empty(0)
            for row in np.unique(rows):
                own = rows == row
                dist = np.concatenate([self.dist[at + row], exact[own]])
                found = np.concatenate([self.ids[at + row], ids[cols[own]]])
                best = np.lexsort((found, dist))[: self.k]
                self.dist[at + row], self.ids[at + row] = dist[best], found[best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    return flat.reshape(len(column), -1)


def scan(vectors: DataFrame, keys: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """Exact search of a bounded block of queries: qkey, vec_id, score of the k nearest of each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(queries, k)
        for batch in batches:
            if batch.num_rows:
                near.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield _found(np.array(keys, "i8"), near)

    return vectors.select("vec_id", "vec").mapInArrow(run, FOUND)


def _found(keys: np.ndarray, near: Nearest) -> pa.RecordBatch:
    rows, cols = np.nonzero(np.isfinite(near.dist))
    return pa.RecordBatch.from_arrays([pa.array(keys[rows], pa.int64()), pa.array(near.ids[rows, cols], pa.int64()), pa.array(near.dist[rows, cols], pa.float64())], names=["qkey", "vec_id", "score"])


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among rows that may repeat."""
    by_rank = Window.partitionBy("qkey").orderBy("score", "vec_id")
    return found.groupBy("qkey", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)


class Family:
    """The hash functions of all tables; equal for equal arguments on every machine."""

    def __init__(self, dim: int, per_table: int, width: float, distance: float):
        rng = np.random.default_rng(SEED)
        self.per_table, self.width, self.distance = per_table, width, distance
        self.directions = rng.standard_normal((dim, TABLES * per_table))
        self.shift = rng.uniform(0, width, TABLES * per_table)
        self.mix = rng.integers(1, 2**63 - 1, per_table, dtype="i8") | 1

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector, table and projection its place, in cells."""
        return ((vectors @ self.directions + self.shift) / self.width).reshape(len(vectors), TABLES, self.per_table)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """Bucket numbers of cells, the last axis being a table's projections."""
        with np.errstate(over="ignore"):
            return (cells.astype("i8") * self.mix).sum(-1)

    def probes(self, place: np.ndarray, success: float) -> Iterator[np.ndarray]:
        """The cells that a query visits in one table, likeliest first, until they hold a neighbour with this chance."""
        spread = self.distance / self.width
        base = np.floor(place)
        options = []
        for x in place - base:
            reach = range(-math.ceil(3 * spread) - 1, math.ceil(3 * spread) + 2)
            chance = lambda d, x=x: _normal((d + 1 - x) / spread) - _normal((d - x) / spread)
            options.append(sorted(((chance(d), d) for d in reach), reverse=True))
        first = (0,) * len(options)
        chance_of = lambda at: math.prod(o[i][0] for o, i in zip(options, at, strict=True))
        heap, total = [(-chance_of(first), first)], 0.0
        while heap and total < success:
            chance, at = heapq.heappop(heap)
            total -= chance
            yield base + [o[i][1] for o, i in zip(options, at, strict=True)]
            last = max((j for j, i in enumerate(at) if i), default=0)
            for j in range(last, len(at)):  # each set of steps has one way to be reached
                if at[j] + 1 < len(options[j]):
                    after = (*at[:j], at[j] + 1, *at[j + 1 :])
                    heapq.heappush(heap, (-chance_of(after), after))


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _hashed(rows: DataFrame, id_col: str, family: Family, success: float | None) -> DataFrame:
    """t, bucket, id and vec: of each vector's own buckets, or of those that a query visits until success."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = family.places(_matrix(batch.column(1)))
            if success is None:
                rows = np.repeat(np.arange(batch.num_rows), TABLES)
                tables, buckets = np.tile(np.arange(TABLES), batch.num_rows), family.buckets(np.floor(places)).ravel()
            else:
                each = [(r, t, cells) for r in range(batch.num_rows) for t in range(TABLES) for cells in family.probes(places[r, t], success)]
                rows, tables = np.array([r for r, *_ in each]), np.array([t for _, t, _ in each])
                buckets = family.buckets(np.array([c for *_, c in each]))
            for at in range(0, len(rows), 1 << 14):
                part = slice(at, at + (1 << 14))
                taken = batch.take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays([pa.array(tables[part], pa.int32()), pa.array(buckets[part], pa.int64()), *taken.columns], names=["t", "bucket", "id", "vec"])

    return rows.select(F.col(id_col).alias("id"), "vec").mapInArrow(run, "t int, bucket long, id long, vec array<double>")


def _search_groups(groups: DataFrame, k: int) -> DataFrame:
    """Over rows in order of group, queries before vectors: the nearest of each group's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, queries, near = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            is_vector, ids, vecs = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), _matrix(batch.column(5))
            cuts = [0, *(np.nonzero((names[1:] != names[:-1]).any(1) | (is_vector[1:] != is_vector[:-1]))[0] + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if tuple(names[a]) != group:
                    if near is not None:
                        yield _found(np.concatenate(keys), near)
                    group, keys, queries, near = tuple(names[a]), [], [], None
                if not is_vector[a]:
                    keys.append(ids[a:b])
                    queries.append(vecs[a:b])
                elif keys:
                    near = near or Nearest(np.concatenate(queries), k)
                    near.add(ids[a:b], vecs[a:b])
        if near is not None:
            yield _found(np.concatenate(keys), near)

    ordered = groups.repartition("t", "bucket", "salt").sortWithinPartitions("t", "bucket", "salt", "is_vector")
    return ordered.select("t", "bucket", "salt", "is_vector", "id", "vec").mapInArrow(run, FOUND)


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row for which is_query (of vec_id) holds, itself left out."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(valid(vectors, id_col, vec_col), "vectors")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qkey"), "vec")
    queries = scratch.keep(asked.groupBy("qkey").agg(F.min("vec").alias("vec")), "queries")
    n, wanted = rows.count(), k + 1  # one more, as a query finds itself
    sample = queries.orderBy("qkey").limit(SAMPLE).collect()
    if not sample:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    near = nearest_of(scan(rows, [r.qkey for r in sample], np.array([r.vec for r in sample]), wanted), wanted)
    distance = near.groupBy("qkey").agg(F.max("score").alias("far")).agg(F.percentile("far", 0.75)).first()[0] or 1.0
    family = Family(len(sample[0].vec), hashes(n), WIDTH * distance, distance)

    index = scratch.keep(_hashed(rows, "vec_id", family, None), "index")
    probes = _hashed(queries, "qkey", family, 1 - (1 - recall) ** (1 / TABLES))
    groups = index.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("salts"))
    groups = groups.hint("merge")
    dealt = index.join(groups, ["t", "bucket"]).select("t", "bucket", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(True).alias("is_vector"), "id", "vec")
    sent = probes.join(groups, ["t", "bucket"]).select("t", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_vector"), "id", "vec")
    found = scratch.keep(nearest_of(_search_groups(dealt.unionByName(sent), wanted), wanted), "found")

    enough = found.groupBy("qkey").count().where(F.col("count") >= min(wanted, n))
    rest = scratch.keep(queries.join(enough.hint("merge"), "qkey", "left_anti"), "short")
    missing = rest.count()
    if missing:
        blocks = math.ceil(missing / BLOCK)  # keys are hashes, so blocks are of about BLOCK queries
        for block in range(blocks):
            held = rest.where(F.pmod("qkey", F.lit(blocks)) == block).collect()
            if held:
                exact = scan(rows, [r.qkey for r in held], np.array([r.vec for r in held]), wanted)
                scratch.add(nearest_of(exact, wanted).select(*found.columns), "exact")
        found = found.join(rest.select("qkey").hint("merge"), "qkey", "left_anti").unionByName(scratch.read("exact", found.schema))
    found = scratch.keep(found, "nearest")
    scratch.drop_all_but("vectors", "nearest")
    by_rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = asked.select("query_id", "qkey").join(found.drop("rank").hint("merge"), "qkey").where(F.col("query_id") != F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the ten nearest found of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
