"""Queries over events: bars, indicators, intervals, windows, funnels and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.jsonx import read_fields
from plumbline.operators import intervals as I
from plumbline.operators import scan
from plumbline.operators import timeseries as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts in UTC and `seconds` since the epoch."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("seconds", F.unix_micros("ts") / 1e6)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bars(events(spark, sf_dir), "event_type", "ts", "value").withColumn("ord", F.date_diff(F.to_date("ord"), F.lit("1970-01-01").cast("date")))


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


_BARS = """
b AS (
  SELECT event_type AS series_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS ord, arg_min(value, {t: ts, e: event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {t: ts, e: event_id}) AS close, count(*) AS n
  FROM events GROUP BY ALL
), v AS (
  SELECT *, row_number() OVER w AS i, lag(close) OVER w AS before, CASE WHEN count(*) OVER f = 9 THEN CASE WHEN max(high) OVER f = min(low) OVER f THEN 50 ELSE (close - min(low) OVER f) / (max(high) OVER f - min(low) OVER f) * 100 END END AS rsv
  FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ord), f AS (PARTITION BY series_id ORDER BY ord ROWS 8 PRECEDING)
)"""
_add("ev_ohlc_daily", lambda s, d: daily(s, d).select("series_id", F.col("ord").cast("int"), "open", "high", "low", "close", "n"), f"WITH {_BARS} SELECT series_id, CAST(ord AS INT) AS ord, open, high, low, close, n FROM b")
_add(
    "ev_ma5_ma20",
    lambda s, d: S.rolling_mean(S.rolling_mean(daily(s, d), "close", 5), "close", 20).select("series_id", F.col("ord").cast("int"), *_r("MA5", "MA20")),
    f"""WITH {_BARS} SELECT series_id, CAST(ord AS INT) AS ord, round(CASE WHEN count(*) OVER a = 5 THEN avg(close) OVER a END, 6) AS "MA5", round(CASE WHEN count(*) OVER c = 20 THEN avg(close) OVER c END, 6) AS "MA20" FROM b WINDOW a AS (PARTITION BY series_id ORDER BY ord ROWS 4 PRECEDING), c AS (PARTITION BY series_id ORDER BY ord ROWS 19 PRECEDING)""",
)
_add(
    "ev_rsi6",
    lambda s, d: S.rsi(daily(s, d)).select("series_id", F.col("ord").cast("int"), *_r("RSI6")),
    f"""WITH RECURSIVE {_BARS}, r AS (
      SELECT series_id, ord, i, close, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM v WHERE i = 1
      UNION ALL
      SELECT v.series_id, v.ord, v.i, v.close, CASE WHEN v.i <= 7 THEN r.g + greatest(v.close - r.close, 0) / 6 ELSE (r.g * 5 + greatest(v.close - r.close, 0)) / 6 END, CASE WHEN v.i <= 7 THEN r.l + greatest(r.close - v.close, 0) / 6 ELSE (r.l * 5 + greatest(r.close - v.close, 0)) / 6 END
      FROM r JOIN v ON v.series_id = r.series_id AND v.i = r.i + 1)
    SELECT series_id, CAST(ord AS INT) AS ord, round(CASE WHEN i <= 6 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END, 6) AS "RSI6" FROM r""",
)
_add(
    "ev_kdj9",
    lambda s, d: S.kdj(daily(s, d)).select("series_id", F.col("ord").cast("int"), *_r("K", "D", "J")),
    f"""WITH RECURSIVE {_BARS}, r AS (
      SELECT series_id, ord, i, rsv, CASE WHEN rsv IS NULL THEN 50.0::DOUBLE ELSE (100 + rsv) / 3 END AS k, CASE WHEN rsv IS NULL THEN 50.0::DOUBLE ELSE (100 + (100 + rsv) / 3) / 3 END AS d FROM v WHERE i = 1
      UNION ALL
      SELECT v.series_id, v.ord, v.i, v.rsv, CASE WHEN v.rsv IS NULL THEN r.k ELSE (2 * r.k + v.rsv) / 3 END, CASE WHEN v.rsv IS NULL THEN r.d ELSE (2 * r.d + (2 * r.k + v.rsv) / 3) / 3 END
      FROM r JOIN v ON v.series_id = r.series_id AND v.i = r.i + 1)
    SELECT series_id, CAST(ord AS INT) AS ord, round(CASE WHEN rsv IS NOT NULL THEN k END, 6) AS "K", round(CASE WHEN rsv IS NOT NULL THEN d END, 6) AS "D", round(CASE WHEN rsv IS NOT NULL THEN 3 * k - 2 * d END, 6) AS "J" FROM r""",
)
_add("ev_indicators", lambda s, d: S.indicators(daily(s, d)).select("series_id", F.col("ord").cast("int"), *_r("MA5", "MA20", "RSI6", "K", "D", "J"), F.col("_indicator_metadata.adjustment_mode").alias("mode")),
    f"""WITH a AS ({ORACLE_SQL["ev_ma5_ma20"]}), b AS ({ORACLE_SQL["ev_rsi6"]}), c AS ({ORACLE_SQL["ev_kdj9"]}) SELECT a.series_id, a.ord, "MA5", "MA20", "RSI6", "K", "D", "J", 'raw' AS mode FROM a JOIN b ON a.series_id = b.series_id AND a.ord = b.ord JOIN c ON a.series_id = c.series_id AND a.ord = c.ord""",
)


def spans(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    return events(spark, sf_dir).select(group, F.col("seconds").alias("start"), (F.col("seconds") + 60 * F.col("value")).alias("end"))


_SPANS = "p AS (SELECT *, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 60 * value AS \"end\" FROM events)"
_ISLANDS = 'q AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), m AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isle FROM q), z AS (SELECT user_id, min(start) AS a, max("end") AS b FROM m GROUP BY user_id, isle)'
_add("ev_interval_union", lambda s, d: I.covered(spans(s, d, "user_id"), "user_id").select("user_id", F.round("seconds", 3).alias("seconds")), f"WITH {_SPANS}, {_ISLANDS} SELECT user_id, round(sum(b - a), 3) AS seconds FROM z GROUP BY user_id")
_add("ev_interval_islands", lambda s, d: I.islands(spans(s, d, "user_id"), "user_id").select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end")), f'WITH {_SPANS}, {_ISLANDS} SELECT user_id, round(a, 3) AS start, round(b, 3) AS "end" FROM z')
_add("ev_peak_inflight", lambda s, d: I.peak(spans(s, d, "event_type"), "event_type"), f'WITH {_SPANS} SELECT event_type, CAST(max(o) AS BIGINT) AS peak FROM (SELECT event_type, sum(delta) OVER (PARTITION BY event_type ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS o FROM (SELECT event_type, start AS t, 1 AS delta FROM p UNION ALL SELECT event_type, "end", -1 FROM p)) GROUP BY event_type')
_add(
    "ev_overlap_pairs",
    lambda s, d: I.overlapping_pairs(spans(s, d, "user_id").join(events(s, d).select("user_id", F.col("seconds").alias("start"), "event_type"), ["user_id", "start"]).where("event_type = 'purchase'"), spans(s, d, "user_id").join(events(s, d).select("user_id", F.col("seconds").alias("start"), "event_type"), ["user_id", "start"]).where("event_type = 'error'"), "user_id", 3600.0).groupBy("l.user_id").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {_SPANS} SELECT l.user_id, count(*) AS n FROM p l JOIN p r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'error' AND l.start < r."end" AND r.start < l."end" GROUP BY l.user_id""",
)
_add("ev_trailing_30m", lambda s, d: S.trailing_sum(events(s, d).withColumn("sec", F.floor("seconds")), "sec", "value", 1800, series="event_type").select("event_id", F.round("trailing", 6).alias("trailing")), "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW), 6) AS trailing FROM events")
_add("ev_tumbling_1h", lambda s, d: events(s, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "total"), "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
_add(
    "ev_sliding_1h",
    lambda s, d: events(s, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("half"), "n"),
    "SELECT half, count(*) AS n FROM (SELECT unnest([CAST(epoch(ts) AS BIGINT) // 1800 * 1800, CAST(epoch(ts) AS BIGINT) // 1800 * 1800 - 1800]) AS half FROM (SELECT date_trunc('second', ts) AS ts FROM events)) GROUP BY half",
)
_add(
    "ev_session_gap",
    lambda s, d: events(s, d).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")),
    "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s) GROUP BY user_id",
)


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type the cumulative count and value, by seconds since the first event."""
    order = ["seconds", "event_id"]
    dealt = scan.ranged(events(spark, sf_dir).withColumn("large", (F.col("value") > 10).cast("long")), ["event_type"], order)
    rows = scan.running(dealt, ["event_type"], order, sums={"raw": F.lit(1).cast("long"), "n_large": F.coalesce("large", F.lit(0).cast("long"))})
    first = dealt.groupBy("event_type").agg(F.min("seconds").alias("first"))
    return rows.join(first, "event_type").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("ord"), (F.col("seconds") - F.col("first")).alias("at"), "raw", F.col("n_large").alias("large"), "user_id", "value")


_CHECK = "c AS (SELECT event_type AS series_id, event_id AS ord, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type) AS spot, count(*) OVER w AS raw, count(*) FILTER (value > 10) OVER w AS large, user_id, value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) / 1e6, event_id ROWS UNBOUNDED PRECEDING))"
_add("ev_cumulative_checks", lambda s, d: S.cumulative_violations(checkpoints(s, d), ["raw", "large", "value"], order="ord"), f"WITH {_CHECK} SELECT series_id, CAST(sum(CASE WHEN raw < r THEN 1 ELSE 0 END) AS BIGINT) AS raw, CAST(sum(CASE WHEN large < l THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(sum(CASE WHEN value < v THEN 1 ELSE 0 END) AS BIGINT) AS value FROM (SELECT *, lag(raw) OVER w AS r, lag(large) OVER w AS l, lag(value) OVER w AS v FROM c WINDOW w AS (PARTITION BY series_id ORDER BY ord)) GROUP BY series_id")
_add("ev_asof_recent_rate", lambda s, d: S.recent_rate(checkpoints(s, d), "at", "raw", span=86400.0).select("series_id", "last", "then", F.round("rate", 9).alias("rate")), f"""WITH {_CHECK}, e AS (SELECT series_id, max(spot) AS t_end, max(raw) AS last FROM c GROUP BY 1), a AS (SELECT c.series_id, max(spot) AS t_then, max(raw) AS "then" FROM c JOIN e USING (series_id) WHERE spot <= t_end - 86400 GROUP BY 1) SELECT series_id, last, "then", round((last - "then") / (t_end - t_then), 9) AS rate FROM e JOIN a USING (series_id)""")
_add("ev_zero_gap", lambda s, d: S.zero_gap(events(s, d), "seconds", series="event_type").select("event_type", F.round("max_gap", 3).alias("max_gap")), "SELECT event_type, round(max(g), 3) AS max_gap FROM (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events) GROUP BY 1")
_add(
    "ev_downsample",
    lambda s, d: S.downsample(checkpoints(s, d).withColumn("label", F.floor(F.col("at") / 864000)), "label", 24).select("series_id", "ord"),
    f"""WITH {_CHECK}, m AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n, floor(spot / 864000) AS lab, lag(floor(spot / 864000)) OVER w AS was FROM c WINDOW w AS (PARTITION BY series_id ORDER BY ord)),
    q AS (SELECT *, CASE WHEN i = 1 OR i = n OR lab IS DISTINCT FROM was THEN 1 ELSE 0 END AS must FROM m), k AS (SELECT *, sum(must) OVER (PARTITION BY series_id) AS req, sum(1 - must) OVER (PARTITION BY series_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS k FROM q),
    p AS (SELECT DISTINCT series_id, ((j + 1) * (n - req)) // (least(24 - req, n - req) + 1) AS pick FROM (SELECT DISTINCT series_id, n, req FROM k) x, range(0, 24) t(j) WHERE j < least(24 - req, n - req))
    SELECT k.series_id, k.ord FROM k LEFT JOIN p ON p.series_id = k.series_id AND p.pick = k.k AND k.must = 0 WHERE n <= 24 OR must = 1 OR p.pick IS NOT NULL""",
)
_add("ev_funnel", lambda s, d: S.funnel(events(s, d), "user_id", "event_type", ("view", "click", "signup", "purchase")).select("place", "stage", "users", F.round("share", 6).alias("share")), "WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'signup') AS c, bool_or(event_type = 'purchase') AS d FROM events GROUP BY 1), n AS (SELECT count(*) FILTER (a) AS v, count(*) FILTER (a AND b) AS k, count(*) FILTER (a AND b AND c) AS s, count(*) FILTER (a AND b AND c AND d) AS p FROM u) SELECT 0 AS place, 'view' AS stage, v AS users, 1.0::DOUBLE AS share FROM n UNION ALL SELECT 1, 'click', k, round(k / v, 6) FROM n UNION ALL SELECT 2, 'signup', s, round(s / v, 6) FROM n UNION ALL SELECT 3, 'purchase', p, round(p / v, 6) FROM n")
_add("ev_funnel_faults", lambda s, d: S.funnel_faults(S.funnel(events(s, d), "user_id", "event_type", ("view", "click", "signup", "purchase"))).select("place"), "SELECT 0 AS place WHERE false")
_add("ev_pivot_status", lambda s, d: events(s, d).groupBy("user_id").pivot("event_type", ["view", "click", "signup", "purchase", "error"]).count().na.fill(0), """SELECT user_id, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""")
_add("ev_last3", lambda s, d: events(s, d).withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 3").select("event_type", "n", "event_id", "value"), "SELECT event_type, CAST(n AS INT) AS n, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
_add(
    "ev_props_coverage",
    lambda s, d: events(s, d).select(F.explode_outer(F.map_keys(read_fields(F.col("props"), ("k", "platform", "price")))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("rows")),
    "SELECT 'k' AS field, count(*) AS rows FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT NULL, count(*) FROM events WHERE json_extract_string(props, '$.k') IS NULL HAVING count(*) > 0",
)
_add("ev_rank_functions", lambda s, d: events(s, d).select("event_id", *[f().over(Window.partitionBy("user_id", "event_type").orderBy("value", "event_id")).cast("int").alias(n) for n, f in (("rank", F.rank), ("dense", F.dense_rank), ("quarter", lambda: F.ntile(4)))]), """SELECT event_id, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense, CAST(ntile(4) OVER w AS INT) AS quarter FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value, event_id)""")
