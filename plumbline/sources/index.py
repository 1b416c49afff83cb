"""Partitioned URL indexes: scans by scope, and files left out by their statistics before any is opened.

A shard map holds the least and greatest reversed host of each file. It is small, one row a file, and selects the paths
that a scan reads; Parquet then skips row groups by the same prefix, which the scope predicates are written as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import urls

# The columns of an index row, besides the partitions crawl and subset.
COLUMNS = (
    "url_surtkey", "url", "url_host_name", "url_host_name_reversed", "url_path", "fetch_time", "fetch_status",
    "content_mime_type", "content_mime_detected", "content_digest", "warc_filename", "warc_record_offset",
    "warc_record_length", "crawl", "subset",
)
SCOPES = ("exact", "domain", "subdomain", "prefix")


def url_index(pages: DataFrame, url: str = "url") -> DataFrame:
    """The rows with host, host_reversed and top-level domain."""
    return pages.withColumn("host", urls.host_of(F.col(url))).withColumn("host_reversed", urls.reversed_host(F.col("host"))).withColumn("tld", F.substring_index("host", ".", -1))


def scope(kind: str, target: str, url: str = "url", reversed_host: str = "host_reversed") -> Column:
    """The predicate of a scope; on reversed hosts, so that it is a prefix test that scans can push down."""
    back = ".".join(reversed(target.lower().split(".")))
    if kind == "exact":
        return F.col(url) == target
    if kind == "prefix":
        return F.col(url).startswith(target)
    if kind == "subdomain":
        return F.col(reversed_host).startswith(back + ".")
    if kind == "domain":
        return (F.col(reversed_host) == back) | F.col(reversed_host).startswith(back + ".")
    raise ValueError(f"unknown scope {kind!r}")


def scan(rows: DataFrame, kind: str, target: str, limit: int | None = None) -> DataFrame:
    """Rows of a scope; for host scopes the implied top-level domain prunes as well."""
    found = rows.where(scope(kind, target))
    if kind in ("domain", "subdomain") and "tld" in rows.columns:
        found = found.where(F.col("tld") == target.lower().rpartition(".")[2])
    return found if limit is None else found.limit(limit)


def shard_map(rows: DataFrame, file: str = "file_name", host: str = "host_reversed") -> DataFrame:
    """file_name, min_host and max_host of each file; files of null hosts only are left out."""
    return rows.where(F.col(host).isNotNull()).groupBy(F.col(file).alias("file_name")).agg(F.min(host).alias("min_host"), F.max(host).alias("max_host"))


def footer_map(spark: SparkSession, paths: list[str], column: str = "url_host_name_reversed") -> DataFrame:
    """The shard map from Parquet footers only: each task reads the footers of some files, no data pages."""
    sc = spark.sparkContext
    opened = spark.createDataFrame([(p,) for p in paths], "file_name string").repartition(max(1, min(len(paths), 4 * sc.defaultParallelism)))

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                meta = pq.read_metadata(path.removeprefix("file:"))
                at = meta.schema.names.index(column)
                stats = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(at).statistics) is not None and s.has_min_max]
                rows.append((path, min((s.min for s in stats), default=None), max((s.max for s in stats), default=None)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["file_name", "min_host", "max_host"])

    return opened.mapInArrow(run, "file_name string, min_host string, max_host string")


def range_map(spark: SparkSession, paths: list[str], column: str = "url_host_name_reversed") -> DataFrame:
    """The shard map of files in any store that Spark reads, from the one column alone; files without values are left out."""
    rows = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file_name"), F.col(column).alias("host"))
    return shard_map(rows, "file_name", "host")


#: Files whose ranges one pass over the targets holds, some 30 MB; more of them take more passes.
MOST_FILES = 200_000


def targets_of(targets: DataFrame) -> DataFrame:
    """target_id, kind, target and the reversed host. targets: target_id, kind, target."""
    host = F.when(F.col("kind").isin("exact", "prefix"), urls.host_of(F.col("target"))).otherwise(F.lower("target"))
    return targets.select("target_id", "kind", "target", urls.reversed_host(host).alias("back"))


def files_of_targets(shards: DataFrame, targets: DataFrame, block: int = MOST_FILES) -> DataFrame:
    """target_id and file_name of the files that may hold rows of each target (back): all targets in one pass.

    Files are sorted by their least host with the greatest host so far; a target's files end where hosts start beyond it, and
    are walked back until none before can reach it.
    """
    import bisect
    import itertools

    import pyarrow as pa

    ranges = [tuple(r) for r in shards.select("min_host", "max_host", "file_name").orderBy("min_host", "file_name").toLocalIterator()]
    kind = dict(targets.dtypes)["target_id"]
    parts = []
    for at in range(0, max(1, len(ranges)), block):
        held = ranges[at : at + block]
        least = [r[0] for r in held]
        reach = list(itertools.accumulate((r[1] for r in held), max))

        def run(batches, held=held, least=least, reach=reach):
            for batch in batches:
                ids, files = [], []
                for target, back, scope_kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    one = scope_kind in ("exact", "prefix")
                    i = bisect.bisect_right(least, back) if one else bisect.bisect_left(least, back + "/")
                    while i and reach[i - 1] >= back:
                        i -= 1
                        if held[i][1] >= back:
                            ids.append(target)
                            files.append(held[i][2])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(files, pa.string())], names=["target_id", "file_name"])

        parts.append(targets.where("back is not null").select("target_id", "back", "kind").mapInArrow(run, f"target_id {kind}, file_name string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rows_of_targets(rows: DataFrame, targets: DataFrame, *, url: str = "url", reversed_host: str = "url_host_name_reversed") -> DataFrame:
    """rows with target_id, once for each target that they belong to: equi-joins on hosts, whatever the number of targets.

    A host meets the targets of itself and of the hosts above it; addresses are compared where hosts are equal.
    """
    labels = F.split(reversed_host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    each = rows.where(F.col(reversed_host).isNotNull()).withColumn("__back", F.explode(above))
    met = each.join(targets.select("target_id", F.col("kind").alias("__kind"), F.col("target").alias("__target"), F.col("back").alias("__back")), "__back")
    own = F.col("__back") == F.col(reversed_host)
    holds = F.when(F.col("__kind") == "domain", True).when(F.col("__kind") == "subdomain", ~own).when(F.col("__kind") == "exact", own & (F.col(url) == F.col("__target"))).otherwise(own & F.startswith(F.col(url), F.col("__target")))
    return met.where(holds).select(*rows.columns, "target_id")


def read_targets(spark: SparkSession, shards: DataFrame, targets: DataFrame, *, limit: int = 5000) -> DataFrame:
    """COLUMNS and target_id of the rows of all targets (target_id, kind, target), at most `limit` a target in order of url.

    Only files that may hold some are read, and of them only COLUMNS that they have; their paths pass the driver.
    """
    asked = targets_of(targets)
    paths = [r.file_name for r in files_of_targets(shards, asked).select("file_name").distinct().orderBy("file_name").toLocalIterator()]
    if not paths:
        return rows_of_targets(spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS)), asked)
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    found = rows_of_targets(rows.select(*[c for c in COLUMNS if c in rows.columns]), asked)
    place = F.row_number().over(Window.partitionBy("target_id").orderBy("url", *[c for c in ("crawl", "fetch_time") if c in found.columns]))
    return found.withColumn("__n", place).where(F.col("__n") <= limit).drop("__n")


def target_events(spark: SparkSession, shards: DataFrame, targets: DataFrame, *, limit: int = 5000) -> DataFrame:
    """Events of the shared protocol for each target: its urls, each once, and a summary with their number and whether the limit was met."""
    held = read_targets(spark, shards, targets, limit=limit).groupBy("target_id", "url").agg(F.count(F.lit(1)).alias("captures"))
    found = held.select("target_id", F.lit("url").alias("type"), "url", "captures", F.lit(None).cast("string").alias("end_reason"))
    counts = held.groupBy("target_id").agg(F.sum("captures").alias("n"))
    ends = targets.select("target_id").join(counts, "target_id", "left").select("target_id", F.lit("summary").alias("type"), F.lit(None).cast("string").alias("url"), F.coalesce("n", F.lit(0)).alias("captures"), F.when(F.col("n") >= limit, "limit").otherwise("exhausted").alias("end_reason"))
    return found.unionByName(ends)


def overlapping(shards: DataFrame, kind: str, target: str) -> DataFrame:
    """Files that may hold rows of a scope. `/` follows `.`, so the range holds the host and all hosts below it, and at most too much."""
    if kind in ("exact", "prefix"):
        from urllib.parse import urlsplit

        back = ".".join(reversed((urlsplit(target).hostname or "").split(".")))
        return shards.where((F.col("min_host") <= back) & (F.col("max_host") >= back))
    back = ".".join(reversed(target.lower().split(".")))
    return shards.where((F.col("max_host") >= back) & (F.col("min_host") < back + "/"))


def check_shard_map(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files in one of map and manifest only: the map may be used if there are none. problem says which."""
    missing = manifest.select("file_name").join(shards, "file_name", "left_anti").withColumn("problem", F.lit("not in map"))
    unknown = shards.select("file_name").join(manifest, "file_name", "left_anti").withColumn("problem", F.lit("not in manifest"))
    return missing.unionByName(unknown)


def pruned_scan(spark: SparkSession, shards: DataFrame, kind: str, target: str, *, url: str = "url", reversed_host: str = "url_host_name_reversed", limit: int | None = None) -> DataFrame | None:
    """A scan of the files that may hold rows of the scope; None if there are none. Paths, one a file, pass the driver."""
    paths = [r.file_name for r in overlapping(shards, kind, target).select("file_name").orderBy("file_name").toLocalIterator()]
    if not paths:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    found = rows.where(scope(kind, target, url, reversed_host))
    return found if limit is None else found.limit(limit)


def manifest(spark: SparkSession, path: str, index_id: str, subset: str = "warc") -> DataFrame:
    """The distinct Parquet paths of a text manifest (gzip or not) that belong to an index, in order of first sight."""
    lines = spark.read.text(path).select(F.trim("value").alias("file_name"), F.monotonically_increasing_id().alias("ord"))
    own = F.col("file_name").contains(f"crawl={index_id}/") & F.col("file_name").contains(f"subset={subset}/") & F.col("file_name").endswith(".parquet") & ~F.col("file_name").contains("..")
    return lines.where(own).groupBy("file_name").agg(F.min("ord").alias("ord"))


def latest_index(collections: DataFrame, requested: str | None = None) -> DataFrame:
    """The requested collection if it is listed, else the first with a well-formed id. collections: id, ord."""
    listed = collections.where(F.col("id").rlike("^CC-MAIN-[0-9]{4}-[0-9]{2}$"))
    return (listed.where(F.col("id") == requested) if requested else listed).orderBy("ord").limit(1)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """NDJSON rows; a file's last line is dropped if it was cut off, any other fault stops the read when it is used."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    last = raw.groupBy("file").agg(F.max("at").alias("last"))
    form = f"{schema}, _corrupt string"
    rows = raw.join(last, "file").select(F.from_json("value", form, {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"), (F.col("at") == F.col("last")).alias("final"))
    torn = F.col("row._corrupt").isNotNull()
    cut_off = torn & F.col("final") & ~F.rtrim("row._corrupt").endswith("}")
    fault = F.when(torn & ~cut_off, F.raise_error(F.concat(F.lit("malformed row: "), "row._corrupt")).cast("boolean")).otherwise(torn)
    return rows.where(~fault).select("row.*").drop("_corrupt")


def captured_at(stamp: Column) -> Column:
    """A 14-digit capture time as ISO-8601 in UTC; null if it is none."""
    return F.date_format(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cdx_events(rows: DataFrame) -> DataFrame:
    """Capture rows (url, timestamp, status, mime, digest) as url events, in order, with capture metadata."""
    meta = F.to_json(F.struct(F.col("mime"), F.col("status"), F.col("digest"), captured_at(F.col("timestamp")).alias("crawl_timestamp")))
    return rows.select(F.lit("url").alias("type"), "url", F.lit("archive").alias("source_class"), captured_at(F.col("timestamp")).alias("observed_at"), meta.alias("metadata"))
