"""Reading corpora, libraries and image folders; writing tables so that they are whole or not there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import authors, doi, first_integer, stripped, venue_in, year_in
from plumbline.operators import scan
from plumbline.operators.corpus import FIELDS, NO_LAB, SCHEMA, integrity_errors, trimmed

BOM = "﻿"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The records of a CSV file with header, trimmed, blank lines gone, missing columns as ''; `ord` is the place in the file."""
    head = spark.read.text(path).limit(1).collect()
    names = [n.strip().strip('"') for n in head[0].value.removeprefix(BOM).split(",")] if head else []
    schema = "`" + "` string, `".join(names) + "` string" if names else SCHEMA.simpleString()
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True).withColumn("ord", F.monotonically_increasing_id())
    full = trimmed(rows)
    return full.where(F.array_join(F.array(*FIELDS), "") != "").select("ord", *FIELDS)


def read_corpus_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The records of a table of five cells: [title](link), meta, abstract, official address and citations."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split(F.trim(F.regexp_replace("value", f"^{BOM}", "")), r"\|", -1).alias("cells"))
    cell = lambda i: stripped(F.get("cells", F.lit(i)))
    linked = r"^\[(.*)\]\(([^)]*)\)$"
    rows = lines.where((F.size("cells") == 7) & cell(1).rlike(linked) & (cell(0) == "") & (cell(6) == ""))
    link = F.nullif(stripped(F.regexp_extract(cell(1), linked, 2)), F.lit(""))
    found = rows.select("ord", stripped(F.regexp_extract(cell(1), linked, 1)).alias("title"), year_in(cell(2)).alias("venue_time"), venue_in(cell(2)).alias("source"), cell(3).alias("abstract"), F.coalesce(F.nullif(cell(4), F.lit("")), link).alias("url"), first_integer(cell(5)).alias("citation"), F.lit(NO_LAB).alias("lab_group"))
    return trimmed(found).select("ord", *FIELDS)


def corpus_faults(spark: SparkSession, path: str) -> DataFrame:
    """line and fault of a CSV file: another header, and records that are damaged. Lines count records after the header."""
    head = spark.read.text(path).limit(1).collect()
    wrong = not head or head[0].value.removeprefix(BOM) != ",".join(FIELDS)
    first = spark.createDataFrame([(1, "header: expected exact columns in order")] if wrong else [], "line long, fault string")
    rows = read_corpus(spark, path)
    numbered = rows.withColumn("line", F.col("ord") + 2)
    return first.unionByName(numbered.select("line", F.explode(integrity_errors()).alias("fault")))


def write_corpus(records: DataFrame, path: str) -> None:
    """One CSV file of the record columns, in a folder; what is written is checked, and removed again if damaged."""
    publish(records.select(*FIELDS).coalesce(1), path, lambda frame, to: frame.write.csv(to, header=True, quote='"', escape='"', emptyValue="", lineSep="\n"), lambda spark, at: corpus_faults(spark, at))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(frame: DataFrame, path: str, write=None, check=None) -> None:
    """Writes beside the target, checks, and then renames, for sinks of one writer: no reader sees a part of a table.

    The old table steps aside first and goes only once the new one is in place; if that fails it comes back. Between the two
    renames there is none; what a crash there leaves aside is put back by the next call. Tables that are read or written by
    several at a time belong into sources.versions.
    """
    spark = frame.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    fs, at = _fs(spark, staged)
    try:
        (write or (lambda f, to: f.write.parquet(to)))(frame, staged)
        faults = [] if check is None else [tuple(r) for r in check(spark, staged).limit(5).collect()]
        if faults:
            raise ValueError(f"not published: {faults}")
        _, target = _fs(spark, path)
        _, aside = _fs(spark, f"{path.rstrip('/')}.aside")
        if fs.exists(aside):
            fs.delete(aside, True) if fs.exists(target) else fs.rename(aside, target)
        old = fs.exists(target)
        if old and not fs.rename(target, aside):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(at, target):
            if old:
                fs.rename(aside, target)
            raise OSError(f"{path} can't be published")
        if old:
            fs.delete(aside, True)
    finally:
        if fs.exists(at):
            fs.delete(at, True)


def write_events(events: DataFrame, path: str, most_bytes: int = 65_536) -> None:
    """NDJSON; a row whose line would be longer than the bound stops the write."""
    line = F.to_json(F.struct(*events.columns))
    bounded = events.select(F.when(F.octet_length(line) <= most_bytes, line).otherwise(F.raise_error(F.lit("an event exceeds the line bound")).cast("string")).alias("value"))
    publish(bounded, path, lambda f, to: f.write.text(to))


def search_results(responses: DataFrame) -> DataFrame:
    """url events from the JSON of meta-searches: engines united, best rank, snippet cut. responses: query, body."""
    item = "struct<url:string,title:string,content:string,engine:string,engines:array<string>,positions:array<int>>"
    rows = responses.select("query", F.posexplode(F.from_json("body", f"struct<results:array<{item}>>")["results"]).alias("ord", "r"))
    none = F.array().cast("array<string>")
    engines = F.array_sort(F.array_union(F.coalesce("r.engines", none), F.when(F.col("r.engine").isNotNull(), F.array("r.engine")).otherwise(none)))
    rank = F.array_min(F.filter(F.coalesce("r.positions", F.array().cast("array<int>")), lambda p: p > 0))
    return rows.where("r.url is not null").select("query", "ord", F.lit("url").alias("type"), F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.substring("r.content", 1, 2000).alias("snippet"), engines.alias("engines"), rank.alias("rank"))


def engine_health(engines: DataFrame, failures: DataFrame) -> DataFrame:
    """category and sorted engines: available, or how they failed. engines: engine; failures: engine, reason."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    kind = F.when(F.col("reason").isNull(), "available").when(reason.rlike("captcha|denied|forbidden|403"), "blocked").when(reason.rlike("timeout|timed out"), "timeout").otherwise("failed")
    return engines.join(failures, "engine", "left").groupBy(kind.alias("category")).agg(F.array_sort(F.collect_set("engine")).alias("engines"))


def product_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and summaries of product batches (batch_id, body): items of one id once, the first; a summary for each batch."""
    item = "struct<product_id:string,title:string,url:string,price:string,shop:string,stock:string>"
    parsed = batches.select("batch_id", F.from_json("body", f"struct<platform:string,page_state:string,query_family:string,items:array<{item}>>").alias("b"))
    rows = parsed.select("batch_id", "b.platform", "b.query_family", F.posexplode("b.items").alias("ord", "i")).where(F.col("i.product_id").rlike("^[0-9]+$"))
    first = Window.partitionBy("batch_id", "i.product_id").orderBy("ord")
    items = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("batch_id", "platform", "query_family", "ord", "i.*")
    ends = parsed.select("batch_id", F.lit("summary").alias("type"), F.coalesce(F.size("b.items"), F.lit(0)).alias("seen"), F.coalesce("b.page_state", F.lit("invalid")).alias("end_reason"))
    return items, ends


def page_state(text: Column, items: Column) -> Column:
    """What a listing page shows, by the first sign found."""
    return F.when(F.lower(text).rlike("captcha|verify you are human|安全验证|滑块"), "captcha").when(F.lower(text).rlike("log ?in|sign in|请登录"), "login").when(F.lower(text).rlike("too many requests|访问频繁"), "rate_limited").when(items > 0, "ready").when(F.lower(text).rlike("no results|没有找到|抱歉"), "empty").otherwise("unknown")


def paper_index(spark: SparkSession, path: str) -> DataFrame:
    """number, section, title and link of a numbered list under headings, and whether numbers go on by one."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
    head = F.nullif(F.regexp_extract("value", r"^#+\s+(.+?)\s*$", 1), F.lit(""))
    dealt = scan.ranged(lines.withColumns({"__all": F.lit(0), "__head": F.when(head.isNotNull(), F.struct("ord", head.alias("section")))}), [], ["ord"])
    heads = scan.running(dealt, ["__all"], ["ord"], most={"__last": "__head"}).withColumn("section", F.col("__last.section"))
    rows = heads.where(F.col("value").rlike(r"^\s*[0-9]+\.\s+")).select("ord", "section", F.regexp_extract("value", r"^\s*([0-9]+)\.", 1).cast("int").alias("number"), F.regexp_extract("value", r"^\s*[0-9]+\.\s+(?:\[)?(.+?)(?:\]\(.*)?\s*$", 1).alias("title"), F.regexp_extract("value", r"\((https?://[^)\s]+)\)", 1).alias("link"))
    before = scan.previous(scan.ranged(rows.withColumn("__all", F.lit(0)), [], ["ord"]), ["__all"], ["ord"], {"__before": "number"})
    return before.select(*rows.columns, F.coalesce(F.col("number") == F.col("__before") + 1, F.lit(True)).alias("contiguous"))


def bibliographic(works: DataFrame) -> DataFrame:
    """Flat candidates from works as JSON (body): title, doi, year, venue and authors."""
    shape = "struct<title:array<string>,DOI:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>"
    w = F.from_json("body", shape)
    return works.select(F.get(w["title"], F.lit(0)).alias("title"), doi(w["DOI"]).alias("doi"), F.get(F.get(w["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.get(w["container-title"], F.lit(0)).alias("venue"), F.coalesce(F.transform(w["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), F.array().cast("array<string>")).alias("authors"))


def author_names(text: Column) -> Column:
    return authors(text)


def images(spark: SparkSession, folder: str, batch: int = 5) -> DataFrame:
    """logical_id, filename, size, sha256, batch_id and position of a folder's image files in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(folder)
    named = files.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    numbered = scan.numbered(named, ["filename", "sha256"])
    return numbered.select(F.format_string("image-%04d", "n").alias("logical_id"), "filename", "size", "sha256", F.format_string("batch-%03d", F.ceil(F.col("n") / batch).cast("int")).alias("batch_id"), (F.pmod(F.col("n") - 1, F.lit(batch)) + 1).alias("position"))


def vault(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (".git", ".trash")) -> DataFrame:
    """path (inside the folder) and content of its text notes, without excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    inside = F.regexp_replace("path", rf"^.*{folder.rstrip('/').rpartition('/')[2]}/", "")
    kept = files.select(inside.alias("path"), F.col("content").cast("string").alias("content"))
    return kept.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded)))).orderBy("path")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a JSON array file."""
    return spark.read.json(path, multiLine=True)


ADAPTERS = {"search_results": search_results, "bibliographic": bibliographic}


def run_adapter(name: str, payload: DataFrame) -> DataFrame:
    """A named source over its payload."""
    if name not in ADAPTERS:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name](payload)


def card_sections(cards: DataFrame) -> DataFrame:
    """logical_id and metadata (map) of each section of cards (path, content): a heading `## id` and a JSON comment under it."""
    parts = cards.select("path", F.explode(F.filter(F.split("content", r"(?m)^##\s+"), lambda _, at: at > 0)).alias("part"))
    body = F.regexp_extract("part", r"(?s)<!--\s*(\{.*?\})\s*-->", 1)
    return parts.select("path", stripped(F.regexp_extract("part", r"^([^\r\n]*)", 1)).alias("logical_id"), F.from_json(F.nullif(body, F.lit("")), "map<string,string>").alias("metadata"))


def topics(values: Column) -> Column:
    """The distinct topics of comma-separated lists, in order."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, "[,，;；]"))), stripped), lambda t: t != ""))


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more rows than the bound are an error, not cut."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *held]
    return "\n".join("| " + " | ".join(map(text, line)) + " |" for line in lines)


# What a candidate's state is called in its index.
STATES = {"pending_screening": "待筛选", "pending_comparison": "待比较", "pending_review": "待审核", "approved": "已批准待实施", "adopted": "已采用", "deferred": "暂缓", "rejected": "不采用"}
OPEN_STATES = ("pending_review", "approved")


def table_text(text: Column) -> Column:
    """A text that stands in a cell of a Markdown table: no markup, no cell mark, no link, one line."""
    out = text
    for mark, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("|", "&#124;"), ("\n", " "), ("[", "&#91;"), ("]", "&#93;")):
        out = F.replace(out, F.lit(mark), F.lit(put))
    return out


def candidate_index(candidates: DataFrame) -> DataFrame:
    """place and line of each candidate (id, title, owner, status, delta, note) in an index: those that wait for a decision first, then by id."""
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    cell = F.concat(table_text(F.col("delta")), F.lit("；"), table_text(F.coalesce("note", F.lit("尚未审核"))))
    line = F.concat(F.lit("| [[候选分析/"), "id", F.lit("|"), table_text(F.col("title")), F.lit("]] | "), table_text(F.col("owner")), F.lit(" | "), F.try_element_at(names, F.col("status")), F.lit(" | "), cell, F.lit(" |"))
    placed = scan.numbered(candidates.withColumn("__late", ~F.col("status").isin(*OPEN_STATES)), ["__late", "id"], "place")
    return placed.select("place", line.alias("line"))


def sparkline(values: list[float]) -> str:
    """Values as a line of eight levels."""
    if not values:
        return ""
    low, high = min(values), max(values)
    return "".join("▁▂▃▄▅▆▇█"[0 if high == low else int((v - low) / (high - low) * 7)] for v in values)
