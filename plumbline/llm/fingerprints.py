"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words between ASCII white space, A-Z lower-cased; a term's weight is how often it stands there.
Each of SAMPLES samples draws for every term gamma variates r and c (shape 2) and a uniform beta from the term alone, and
keeps the least ln c - r * (t - beta + 1) with t = floor(ln weight / r + beta). Two texts agree in a sample with the
chance of their generalised Jaccard similarity: shared weight (smaller counts) over all weight (larger counts). What is
kept of a sample are 16 bits of its least value, which tell term and t; a fingerprint is SAMPLES times four hex digits.

Draws come from digests by linear congruences, so equal texts have equal fingerprints in every run and engine.

fingerprint_pairs() also edits each text with the one that follows it by descending id. Rows lie in ranges of ids of at
most BUCKET_ROWS rows and some BUCKET_CHARS characters; the first row of a range also stands at the end of the range
before (of the last range, for the very first). So one exchange of the texts serves the neighbours, the terms and the
draws: a term's draws are made once for all texts of a range. Range limits are found from ids and lengths alone, written
to the shared folder; tasks get 16 bytes a range, at most MOST_BOUNDS of them, beyond which ranges grow instead.

Defined cases: a null text counts as empty. A text without terms has the empty fingerprint, alike with an empty one (1)
and with no other (0). A single row follows itself. Rows that repeat an id follow each other by a digest of the text;
null ids come last. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, lower_ascii, table

SAMPLES = 48
#: Modulus of the congruences that turn a term's digest into uniform numbers.
PRIME = 2**31 - 1
#: A sample is 16 bits of its least value in steps of 1 / STEPS.
STEPS = 2**24

BUCKET_ROWS = 2048
BUCKET_CHARS = 16_000_000
MOST_BOUNDS = 1_000_000
#: Characters that one task takes.
TASK_CHARS = 8_000_000

LAST = 2**63 - 1
SPACE = r"[\x20\x09-\x0D]+"


def coefficient(part: str, sample: int, draw: int) -> int:
    """A fixed number below 2**28 for each part of a congruence, sample and draw."""
    return int(hashlib.md5(f"cws:{part}:{sample}:{draw}".encode()).hexdigest()[:7], 16)


def _drawn(high: Column, low: Column, sample: int, draw: int) -> Column:
    """A number below PRIME for each term."""
    a, b, c = (F.lit(coefficient(part, sample, draw)).cast("long") for part in "abc")
    return (high * a + low * b + c) % F.lit(PRIME)


def _gamma(drawn: Column) -> Column:
    """A gamma variate of shape 2: minus the log of a product of two uniform numbers, of 15 and 16 bits."""
    return -F.ln((F.shiftright(drawn, 16).cast("double") + 0.5) * (drawn.bitwiseAND(F.lit(65535)).cast("double") + 0.5) / F.lit(float(2**31)))


def least_value(high: Column, low: Column, log_weight: Column, sample: int) -> Column:
    """What a sample minimises over terms; high and low are two 30-bit halves of the term's digest."""
    r, log_c = _gamma(_drawn(high, low, sample, 0)), F.ln(_gamma(_drawn(high, low, sample, 1)))
    beta = (_drawn(high, low, sample, 2).cast("double") + 0.5) / F.lit(float(PRIME))
    return log_c - r * (F.floor(log_weight / r + beta).cast("double") - beta + 1)


def terms(text: Column) -> Column:
    """Cutting at white space takes a fifth of the time of extracting each word."""
    return F.array_remove(F.split(lower_ascii(text), SPACE), "")


def signatures(counted: DataFrame, group: str, owner: str) -> DataFrame:
    """group, owner and codes (SAMPLES numbers, null without terms) from rows group, owner, term and n (its weight).

    Owners are longs, distinct within a group. A term of a weight gets its draws once a group; owners of it are listed, as
    many as the group has. Rows whose term is null give owners without terms their place. The lambda over owners keeps the
    draws in a projection of its own: fused with its neighbours, SAMPLES of them would be too long a method to compile.
    """
    digest = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 15), 16, 10).cast("long")
    shared = counted.groupBy(group, "term", "n").agg(F.collect_list(owner).alias("owners"))
    halves = shared.select(group, "owners", digest.alias("digest"), F.ln(F.col("n").cast("double")).alias("log_n"))
    high, low = F.shiftright("digest", 30), F.col("digest").bitwiseAND(F.lit(2**30 - 1))
    values = halves.select(group, F.transform("owners", lambda o: o).alias("owners"), *[least_value(high, low, F.col("log_n"), k).alias(f"v{k}") for k in range(SAMPLES)])
    each = values.select(group, F.explode("owners").alias(owner), *[f"v{k}" for k in range(SAMPLES)])
    least = each.groupBy(group, owner).agg(*[F.min(f"v{k}").alias(f"v{k}") for k in range(SAMPLES)])
    code = lambda k: F.pmod(F.floor(F.col(f"v{k}") * F.lit(float(STEPS))), F.lit(65536))
    return least.select(group, owner, F.when(F.col("v0").isNotNull(), F.array(*[code(k) for k in range(SAMPLES)])).alias("codes"))


def spelt(codes: Column) -> Column:
    """A fingerprint as text."""
    return F.coalesce(F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without terms are alike, one of them is like no other."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / F.lit(float(SAMPLES)))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, n_chars and fingerprint of each row, without neighbours."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("row_id", "text", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("k1"), F.md5(F.col("text").cast("binary")).alias("k2"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).withColumn("bucket", F.pmod("k1", F.lit(65536)))
    counted = texts.select("bucket", "k1", F.explode_outer(terms(F.col("text"))).alias("term")).groupBy("bucket", "k1", "term").agg(F.count("term").alias("n"))
    found = signatures(counted, "bucket", "k1").select("k1", spelt(F.col("codes")).alias("fingerprint"))
    return keyed.drop("text").join(found, "k1").select("row_id", "n_chars", "fingerprint")


class Ranges:
    """Limits of ranges of rows in order of (place, digest); bound by MOST_BOUNDS."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        self.rows, self.chars = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()
        parts = 1 + max(self.rows // (16 * BUCKET_ROWS), self.chars // (16 * BUCKET_CHARS))
        dealt = scratch.keep(keys.repartitionByRange(int(parts), "place", "digest").withColumn("part", F.spark_partition_id()), "dealt")
        so_far = Window.partitionBy("part").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, 0)
        cut = dealt.withColumn("cut", F.floor(F.sum(F.col("n_chars") / BUCKET_CHARS + F.lit(1 / BUCKET_ROWS)).over(so_far)))
        firsts = sorted(tuple(r) for r in cut.groupBy("part", "cut").agg(F.min(F.struct("place", "digest")).alias("first")).select("first.*").distinct().collect())
        step = 1 + len(firsts) // MOST_BOUNDS
        self.firsts = firsts[::step]
        scratch.drop("dealt")

    def bucket(self, place: Column, digest: Column) -> Column:
        """Number of the range that holds a row: a binary search."""
        n = len(self.firsts)
        at_place, at_digest = (F.split(F.lit(",".join(str(f[i]) for f in self.firsts)), ",").cast("array<bigint>") for i in (0, 1))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])

        def probe(at: Column, step: Column) -> Column:
            low, tie = F.get(at_place, at + step), F.get(at_digest, at + step)
            below = (low < place) | ((low == place) & (tie <= digest))
            return F.when((at + step < n) & F.coalesce(below, F.lit(False)), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), probe)

    def is_first(self, bucket: Column, place: Column, digest: Column) -> Column:
        at_place, at_digest = (F.split(F.lit(",".join(str(f[i]) for f in self.firsts)), ",").cast("array<bigint>") for i in (0, 1))
        return (F.get(at_place, bucket) == place) & (F.get(at_digest, bucket) == digest)


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text has the last half of its characters, rounded down, replaced by as many first ones of the next text (or
    all of it) by descending id; the last row is followed by the first.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    id_ = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.coalesce(F.bitwise_not(id_), F.lit(LAST)).alias("place"), F.xxhash64(text).alias("digest")]
    ranges = Ranges(scratch.keep(docs.select(*order, F.length(text).cast("long").alias("n_chars")), "keys"), scratch)
    scratch.drop("keys")
    if not ranges.rows:
        return docs.select(id_.alias("row_id"), F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))

    n = len(ranges.firsts)
    rows = docs.select(id_.alias("row_id"), text.alias("text"), *order).withColumn("bucket", ranges.bucket(F.col("place"), F.col("digest")))
    own, before = F.struct("bucket", F.lit(0).alias("end")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("end"))
    stands = F.when(ranges.is_first(F.col("bucket"), F.col("place"), F.col("digest")), F.array(own, before)).otherwise(F.array(own))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, int(ranges.chars // TASK_CHARS)))
    dealt = rows.select("row_id", "text", "place", "digest", F.explode(stands).alias("s")).select("row_id", "text", "place", "digest", "s.*").repartition(tasks, "bucket")
    in_order = Window.partitionBy("bucket").orderBy("end", "place", "digest", "row_id")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    placed = dealt.withColumns({"at": F.row_number().over(in_order).cast("long"), "next": F.lead("text").over(in_order)}).withColumn("edited", edited)

    both = placed.select("bucket", F.explode(F.array(F.struct((2 * F.col("at")).alias("owner"), "text"), F.struct((2 * F.col("at") + 1).alias("owner"), F.col("edited").alias("text")))).alias("x")).select("bucket", "x.*")
    counted = both.select("bucket", "owner", F.explode_outer(terms(F.col("text"))).alias("term")).groupBy("bucket", "owner", "term").agg(F.count("term").alias("n"))
    codes = signatures(counted, "bucket", "owner")
    pair = codes.groupBy("bucket", F.floor(F.col("owner") / 2).alias("at")).agg(*[F.first(F.when(F.col("owner") % 2 == i, F.col("codes")), ignorenulls=True).alias(c) for i, c in enumerate(("own", "edit"))])
    following = pair.withColumn("following", F.lead("own").over(Window.partitionBy("bucket").orderBy("at")))
    told = following.select("bucket", "at", spelt(F.col("own")).alias("fingerprint"), spelt(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
    heads = placed.where("end = 0").select("bucket", "at", "row_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return heads.join(told, ["bucket", "at"]).drop("bucket", "at")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: fingerprints of every document and its edited text, and their likeness."""
    return fingerprint_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


_C = "CAST('0x' || substr(md5('cws:{}:' || k || ':{}'), 1, 7) AS BIGINT)"
_H = ", ".join(f"(hi * {_C.format('a', j)} + lo * {_C.format('b', j)} + {_C.format('c', j)}) % {PRIME} AS h{j}" for j in range(3))
_G = "-ln(((h{0} >> 16)::DOUBLE + 0.5::DOUBLE) * ((h{0} & 65535)::DOUBLE + 0.5::DOUBLE) / 2147483648.0::DOUBLE)"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents
), s AS (
  SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT doc_id, n_chars, next_id, text, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM s
), o AS (
  SELECT doc_id, 0 AS side, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), c AS (
  SELECT doc_id, side, term, count(*) AS n FROM (SELECT doc_id, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM o) GROUP BY ALL
), t AS (
  SELECT term, n, x >> 30 AS hi, x & {2**30 - 1} AS lo, k FROM (SELECT DISTINCT term, n, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS x FROM c), (SELECT unnest(range({SAMPLES})) AS k)
), u AS (
  SELECT term, n, k, {_H} FROM t
), r AS (
  SELECT term, n, k, {_G.format(0)} AS r, ln({_G.format(1)}) AS log_c, (h2::DOUBLE + 0.5::DOUBLE) / {PRIME}.0::DOUBLE AS beta FROM u
), v AS (
  SELECT term, n, k, log_c - r * (floor(ln(n::DOUBLE) / r + beta) - beta + 1) AS v FROM r
), m AS (
  SELECT doc_id, side, k, ((CAST(floor(min(v) * {STEPS}.0::DOUBLE) AS BIGINT) % 65536) + 65536) % 65536 AS code FROM c JOIN v USING (term, n) GROUP BY ALL
), f AS (
  SELECT doc_id, side, list(code ORDER BY k) AS codes, string_agg(printf('%04x', code), '' ORDER BY k) AS said FROM m GROUP BY ALL
)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(a.said, '') AS fingerprint, coalesce(b.said, '') AS edited_fingerprint,
       {"CASE WHEN a.codes IS NULL AND b.codes IS NULL THEN 1.0::DOUBLE WHEN a.codes IS NULL OR b.codes IS NULL THEN 0.0::DOUBLE ELSE len(list_filter(list_zip(a.codes, b.codes), lambda z: z[1] = z[2])) / " + str(SAMPLES) + ".0::DOUBLE END"} AS near_edited,
       {"CASE WHEN a.codes IS NULL AND x.codes IS NULL THEN 1.0::DOUBLE WHEN a.codes IS NULL OR x.codes IS NULL THEN 0.0::DOUBLE ELSE len(list_filter(list_zip(a.codes, x.codes), lambda z: z[1] = z[2])) / " + str(SAMPLES) + ".0::DOUBLE END"} AS near_next
FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND a.side = 0 LEFT JOIN f b ON b.doc_id = e.doc_id AND b.side = 1 LEFT JOIN f x ON x.doc_id = e.next_id AND x.side = 0
"""
