"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. Two collections of HALVES keys, each of PER_HALF minhashes, are
computed; a table key is a pair of one key of either collection, so HALVES ** 2 tables of 2 * PER_HALF minhashes cost
2 * HALVES * PER_HALF minhashes only. At the similarity of 0.75 a pair shares no table with chance 0.0001, at 0.8 0.00001.

1. Documents with equal sets are one node, named by their smallest id (partial sums; a group of copies of any size is one row).
2. Keys of the first collection that a node shares with no other are dropped; only what is left meets the second one.
3. In each bucket every node is held against the bucket's smallest node, on full sets: as many pairs as rows. Confirmed
   links make components.
4. Buckets whose nodes are in several components are held again, each time against another node; then what is left is
   settled exactly: nodes of different components in such buckets that share a shingle among their rarest (prefix
   filter: sets as similar as that must) are confirmed as well. Nothing is capped.

Pairs are confirmed where a hub's set meets the members' one after the other; a hub with many members is dealt to many
tasks. Components come from alternating large-star and small-star steps. Steps are written to the shared folder.

Defined cases: texts without words, or null, have no set and link with nothing. Rows that repeat an id count as one
document with links of both: while links are sought, each of its texts has a name of its own (64 bits of id and text). Rows without id link with nothing; they have no component, and
drop_near_duplicates() leaves them. Empty tables give empty tables; other
columns are ignored, or passed on by drop_near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bounded_batches, table

WIDTH = 5
PERCENT = 75
HALVES = 12
PER_HALF = 2
#: Times that buckets of several components are held against another node before the rest is settled by prefixes.
AGAIN = 2
#: Ratio of the sizes at which neighbouring size classes start.
SIZE_STEP = 1.03
#: Groups of shingles whose counts bound what two sets share.
GROUPS = 32
#: Members of a hub that one task confirms.
HUB_ROWS = 512
#: Hubs of more members than that are broadcast up to this number, some 3 MB; beyond it they are joined.
MOST_BROADCAST = 100_000
SEED = 75

_RNG = np.random.default_rng(SEED)
COEFFICIENTS = _RNG.integers(1, 2**63, WIDTH, dtype="u8") * np.uint64(2) + np.uint64(1)
PERMUTE = _RNG.integers(1, 2**63, 2 * HALVES * PER_HALF, dtype="u8") * np.uint64(2) + np.uint64(1)
JOIN = _RNG.integers(1, 2**63, PER_HALF, dtype="u8") * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's shingles; A-Z lower-cased, words between ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "u8")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    width = min(WIDTH, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        total += hashed[k : len(words) - width + 1 + k] * COEFFICIENTS[k]
    return np.unique(_mixed(total))


def half_keys(hashed: np.ndarray) -> np.ndarray:
    """HALVES keys of the first and as many of the second collection."""
    least = np.empty(len(PERMUTE), "u8")
    for at in range(0, len(PERMUTE), 8):
        least[at : at + 8] = (hashed[None] * PERMUTE[at : at + 8, None]).min(1)
    return _mixed((_mixed(least).reshape(2 * HALVES, PER_HALF) * JOIN).sum(1, dtype="u8")).view("i8")


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * shared shingles is percent * all shingles or more; both sorted."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, n (size of the set), k1 and k2 (digest of the set, null without words), keys (both collections)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "i8") if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([half_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["row_id", "n", "k1", "k2", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "row_id long, n long, k1 long, k2 long, keys array<long>")


def table_members(nodes: DataFrame) -> DataFrame:
    """key and node of every table bucket that holds two nodes or more."""
    left = nodes.select("node", F.posexplode(F.slice("keys", 1, HALVES)).alias("i", "half"))
    shared = left.groupBy("i", "half").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("i", "half")
    live = left.join(shared, ["i", "half"], "left_semi").groupBy("node").agg(F.collect_set("i").alias("live"))
    pairs = F.flatten(F.transform("live", lambda i: F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda j: F.xxhash64(i, j, F.get("keys", i), F.get("keys", j + HALVES)))))
    rows = nodes.join(live, "node").select("node", F.explode(pairs).alias("key"))
    full = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    return rows.join(full, "key", "left_semi")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and its set (sorted 64-bit hashes) of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    return rows.join(wanted.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node long, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int = PERCENT) -> DataFrame:
    """hub, member and linked of each distinct (hub, member) pair, judged on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            hubs, nodes, sets_of = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for h, node, raw in zip(hubs, nodes, sets_of, strict=True):
                own = np.frombuffer(raw, "u8")
                if node == h:
                    hub, hub_set = h, own
                elif h == hub:
                    out.append((h, node, alike(hub_set, own, percent)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["hub", "member", "linked"])

    held = scratch.keep(pairs.select("hub", F.col("member").alias("node")).distinct(), name)
    sizes = held.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("salts"))
    hot = scratch.keep(sizes.where("salts > 1"), f"{name}-hot")
    hot = F.broadcast(hot) if hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else hot
    members = held.join(hot, "hub", "left").select("hub", "node", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).alias("salt"), F.lit(1).alias("place"))
    hubs = sizes.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("place"))
    roles = members.unionByName(hubs).join(sets, "node")
    dealt = roles.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "place").select("hub", "node", "hashes")
    return dealt.mapInArrow(run, "hub long, member long, linked boolean")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b), by large-star and small-star steps."""

    def star(frame: DataFrame, large: bool) -> DataFrame:
        both = frame.select("a", "b").unionByName(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))
        reach = both if large else both.where("b < a")
        least = reach.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = reach.where("b > a") if large else reach
        out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(frame: DataFrame):
        return tuple(frame.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    before, turn = None, 0
    while (found := mark(now)) != before and found[0]:
        before, turn = found, turn + 1
        now = scratch.keep(star(star(now, True), False), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def prefix_pairs(sets: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """hub and member of nodes in different components that share one of their rarest shingles.

    held: node and component. Only shingles found in several components can be shared by such a pair: s of a set's n. Sets of
    n and m shingles must share o = percent * (n + m) / (100 + percent) of them, so any s - o + 1 of either hold a shared one,
    here the rarest. Sizes fall into narrow classes; a set has a prefix for each class in reach, as o tells for both classes.
    Shingles fall into GROUPS by their hash: of each group a pair shares at most the smaller count, and the sum must reach o.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(raw, "i8")
                rows = [np.full(len(own), v) for v in (node, component, len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*rows, own)], names=["node", "component", "n", "shingle"])

    each = sets.join(held, "node").select("node", "component", "hashes").mapInArrow(opened, "node long, component long, n long, shingle long")
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("found"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", "found")
    shared = each.join(counts, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("found", "shingle"))).alias("order"))
    size_class = lambda n: F.floor(F.ln(n) / F.ln(F.lit(SIZE_STEP)) + 1e-9).cast("int")
    least = lambda c: F.floor(F.pow(F.lit(SIZE_STEP), c) + 1e-9)
    own = size_class(F.col("n").cast("double"))
    able = shared.withColumn("s", F.size("order")).where(F.col("s") * 100 >= percent * F.col("n")).withColumn("own", own)
    share = lambda g: F.size(F.filter("order", lambda t: F.pmod(t["shingle"], F.lit(GROUPS)) == g))
    able = able.withColumn("groups", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), share))
    reach = F.sequence(size_class(F.greatest(F.col("n") * percent / 100, F.lit(1.0))), size_class(F.col("n") * 100 / percent))
    length = lambda c: F.col("s") - F.ceil(percent * (least(c) + least(F.col("own"))) / (100 + percent)).cast("int") + 1
    parts = F.filter(F.transform(reach, lambda c: F.struct(c.alias("to"), length(c).alias("length"))), lambda p: p["length"] > 0)
    of_class = able.select("node", "component", "n", "own", "groups", "s", "order", F.explode(parts).alias("p"))
    prefix = of_class.select("node", "component", "n", "groups", "own", F.col("p.to").alias("to"), F.explode(F.slice("order", F.lit(1), F.col("p.length"))).alias("it")).select("node", "component", "n", "groups", "own", "to", "it.shingle")
    other = prefix.select(F.col("node").alias("hub"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("groups").alias("others"), F.col("own").alias("to"), F.col("to").alias("own"), "shingle")
    most = F.aggregate(F.zip_with("groups", "others", lambda a, b: F.least(a, b)), F.lit(0), lambda acc, x: acc + x)
    near = (F.col("hub") < F.col("node")) & (F.col("c") != F.col("component")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("m")))
    return prefix.join(other, ["own", "to", "shingle"]).where(near).select("hub", F.col("node").alias("member")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """row_id, n_shingles, component_id and kept of each row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(sketches(docs, id_col, text_col), "rows")
    twice = rows.where("row_id is not null and k1 is not null").groupBy("row_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo != hi")
    if twice.isEmpty():
        return _linked(docs, rows, id_col, text_col, percent, scratch)
    named = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).join(twice, "row_id", "left")
    named = scratch.keep(named.select("row_id", "text", F.when(F.col("lo").isNotNull(), F.xxhash64("row_id", "text")).otherwise(F.col("row_id")).alias("name")), "named")
    apart = Scratch(docs.sparkSession, "minhash-names")
    found = scratch.keep(_linked(named, apart.keep(sketches(named, "name", "text"), "rows"), "name", "text", percent, apart).withColumnRenamed("row_id", "name"), "found")
    names = named.where("row_id is not null").select("row_id", "name").distinct()
    placed = scratch.keep(names.join(found.select("name", "component_id").distinct(), "name"), "placed")
    least = placed.groupBy("row_id").agg(F.min("component_id").alias("b"))
    united = components(placed.join(least, "row_id").select(F.col("component_id").alias("a"), "b"), scratch, "names")
    placed = placed.join(united, F.col("component_id") == F.col("node"), "left").select("row_id", "name", F.coalesce("component", "component_id").alias("component"))
    heads = placed.groupBy("component").agg(F.min("row_id").alias("head"))
    ends = placed.join(heads, "component").select("row_id", "name", "head")
    told = found.select("name", F.col("n_shingles")).join(ends, "name", "left")
    return told.select("row_id", "n_shingles", F.col("head").alias("component_id"), F.coalesce(F.col("row_id") == F.col("head"), F.lit(False)).alias("kept"))


def _linked(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """near_duplicates() of rows whose ids are not repeated with other sets; rows: their sketches."""
    sized = rows.where("row_id is not null and k1 is not null")
    copies = scratch.keep(sized.groupBy("k1", "k2").agg(F.min("row_id").alias("node")), "copies")
    nodes = sized.join(copies.select(F.col("node").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("node"), "keys")
    members = scratch.keep(table_members(nodes), "members")
    sets = scratch.keep(full_sets(docs.where(F.col(id_col).isNotNull()), members, id_col, text_col), "sets")

    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = members.join(hubs, "key").where("hub != node").select("hub", F.col("node").alias("member")).distinct()
    judged = scratch.keep(confirm(pairs, sets, scratch, "pairs-0", percent), "judged-0")
    links = judged.where("linked")
    found = components(links.select(F.col("member").alias("a"), F.col("hub").alias("b")), scratch, "round-0")
    for turn in range(1, AGAIN + 2):
        placed = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        open_ = scratch.keep(placed.join(mixed, "key", "left_semi"), f"open-{turn}")
        if open_.isEmpty():
            break
        if turn <= AGAIN:
            draw = F.xxhash64(F.lit(turn), F.col("node"))
            hubs = open_.groupBy("key").agg(F.min_by("node", draw).alias("hub"), F.min_by("component", draw).alias("c"))
            pairs = open_.join(hubs, "key").where("component != c").select("hub", F.col("node").alias("member")).distinct()
        else:
            pairs = prefix_pairs(sets, open_.select("node", "component").distinct(), percent)
        known = judged.select("hub", "member").unionByName(judged.select(F.col("member").alias("hub"), F.col("hub").alias("member")))
        more = confirm(pairs.join(known, ["hub", "member"], "left_anti"), sets, scratch, f"pairs-{turn}", percent)
        more = scratch.keep(more, f"judged-{turn}")
        judged = judged.unionByName(more)
        if more.where("linked").isEmpty():
            continue
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.where("linked").select(F.col("member").alias("a"), F.col("hub").alias("b")))
        found = components(edges, scratch, f"round-{turn}")
    found = scratch.keep(found, "components")
    scratch.drop_all_but("rows", "copies", "components")
    of_set = rows.join(copies, ["k1", "k2"], "left").withColumn("node", F.when(F.col("row_id").isNotNull(), F.coalesce("node", "row_id")))
    placed = of_set.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return placed.select("row_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows that are kept, and those without id, with the input's columns."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).where("kept").select(F.col("row_id").alias(id_col)).distinct()
    named = docs.join(kept, id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: set size, component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), joint AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM joint JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS spot FROM documents
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.spot
), c AS (
  SELECT node, min(spot) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
