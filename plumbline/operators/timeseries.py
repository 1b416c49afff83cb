"""Time series: rolling means, Wilder RSI, KDJ, cumulative checks, rates and down-sampling.

Rows have a series and an order column. Plain frames are windows; recursive indicators fold the sorted rows of a series as
a stream, as their state needs all earlier rows; numbers, neighbours and trailing sums are two-level scans, so that a hot
series is many tasks. bars() makes bars of ticks, by partial aggregates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import scan
from plumbline.operators.folds import folded_columns

MODES = ("raw", "forward", "backward")


def bars(events: DataFrame, series: str, ts: str, value: str, width: str = "day", tie: str = "event_id") -> DataFrame:
    """open, high, low, close and n of each series and calendar unit."""
    order = F.struct(ts, tie)
    return events.groupBy(F.col(series).alias("series_id"), F.date_trunc(width, ts).alias("ord")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("n")
    )


def _by(series: str, order: str):
    return Window.partitionBy(series).orderBy(order)


def rolling_mean(rows: DataFrame, value: str, size: int, *, series: str = "series_id", order: str = "ord", name: str | None = None) -> DataFrame:
    """The mean of the last `size` values, null before there are as many."""
    frame = _by(series, order).rowsBetween(1 - size, 0)
    return rows.withColumn(name or f"MA{size}", F.when(F.count(value).over(frame) == size, F.avg(value).over(frame)))


class Strength(NamedTuple):
    """Wilder's smoothed gains and losses after n values."""

    n: int = 0
    last: float = 0.0
    gain: float = 0.0
    loss: float = 0.0

    def after(self, value: float, period: int) -> Strength:
        if not self.n:
            return Strength(1, value)
        change = value - self.last
        n, up, down = self.n + 1, max(change, 0.0), max(-change, 0.0)
        if n <= period + 1:
            return Strength(n, value, self.gain + up / period, self.loss + down / period)
        return Strength(n, value, (self.gain * (period - 1) + up) / period, (self.loss * (period - 1) + down) / period)

    def index(self, period: int) -> float | None:
        if self.n <= period:
            return None
        if self.loss == 0:
            return 50.0 if self.gain == 0 else 100.0
        return 0.0 if self.gain == 0 else 100 - 100 / (1 + self.gain / self.loss)


def rsi(rows: DataFrame, value: str = "close", period: int = 6, *, series: str = "series_id", order: str = "ord") -> DataFrame:
    """Wilder's index: seeded by the mean of the first `period` gains and losses; 50 if flat, 100 and 0 if one-sided. Null values are passed over."""

    def row(state: Strength, record: dict) -> tuple[Strength, tuple]:
        if record[value] is None:
            return state, (None,)
        state = state.after(float(record[value]), period)
        return state, (state.index(period),)

    return folded_columns(rows, [series], [order], f"RSI{period} double", begin=lambda record: Strength(), row=row)


def kdj(rows: DataFrame, period: int = 9, *, high: str = "high", low: str = "low", close: str = "close", series: str = "series_id", order: str = "ord") -> DataFrame:
    """K, D and J from where the close lies in the range of the last `period` rows; K and D start from 50."""
    frame = _by(series, order).rowsBetween(1 - period, 0)
    top, bottom = F.max(high).over(frame), F.min(low).over(frame)
    placed = rows.withColumn("rsv", F.when(F.count(close).over(frame) == period, F.when(top == bottom, 50.0).otherwise((F.col(close) - bottom) / F.when(top != bottom, top - bottom) * 100)))

    def row(state: tuple[float, float], record: dict) -> tuple[tuple[float, float], tuple]:
        if record["rsv"] is None:
            return state, (None, None, None)
        k = (2 * state[0] + record["rsv"]) / 3
        d = (2 * state[1] + k) / 3
        return (k, d), (k, d, 3 * k - 2 * d)

    return folded_columns(placed, [series], [order], "K double, D double, J double", begin=lambda record: (50.0, 50.0), row=row).drop("rsv")


def price_errors() -> Column:
    """What is wrong with a row's prices, as messages."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    fault = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    return F.array_compact(F.array(*[fault(finite(c), f"{c} is not finite") for c in ("high", "low", "close")], fault(F.col("high") >= F.col("low"), "high is below low"), fault(F.col("close").between(F.col("low"), F.col("high")), "close is outside"), F.when(F.col("open").isNotNull(), fault(F.col("open").between(F.col("low"), F.col("high")), "open is outside"))))


def indicators(rows: DataFrame, *, means=(5, 20), rsi_periods=(6,), kdj_period: int = 9, mode: str = "raw") -> DataFrame:
    """All indicators and how they were made; rows with price errors, or columns of the results' names, are refused."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    names = {*(f"MA{n}" for n in means), *(f"RSI{n}" for n in rsi_periods), "K", "D", "J", "_indicator_metadata"}
    if clash := names & set(rows.columns):
        raise ValueError(f"columns of results are there already: {', '.join(sorted(clash))}")
    checked = rows.withColumn("close", F.when(F.size(price_errors()) == 0, F.col("close")).otherwise(F.raise_error(F.array_join(price_errors(), "; ")).cast("double")))
    for n in means:
        checked = rolling_mean(checked, "close", n)
    for n in rsi_periods:
        checked = rsi(checked, "close", n)
    made = F.struct(F.col("series_id").alias("series_id"), F.lit(mode).alias("adjustment_mode"), F.array(*map(F.lit, means)).alias("ma"), F.array(*map(F.lit, rsi_periods)).alias("rsi"), F.lit(kdj_period).alias("kdj"), F.lit(50.0).alias("initial_k"), F.lit(50.0).alias("initial_d"))
    return kdj(checked, kdj_period).withColumn("_indicator_metadata", made)


def cumulative_violations(rows: DataFrame, fields: list[str], *, series: str = "series_id", order: str = "ord") -> DataFrame:
    """series and, for each field, in how many rows it falls below the row before."""
    with_before = scan.previous(scan.ranged(rows, [series], [order]), [series], [order], {f"__{f}": f for f in fields})
    return with_before.groupBy(series).agg(*[F.count(F.when(F.col(f) < F.col(f"__{f}"), 1)).alias(f) for f in fields])


def recent_rate(rows: DataFrame, seconds: str, count: str, *, span: float = 30.0, series: str = "series_id") -> DataFrame:
    """Per series: the last count, the count as of `span` seconds before the last row, and the rate between."""
    end = rows.groupBy(series).agg(F.max(seconds).alias("t_end"), F.max_by(count, seconds).alias("last"))
    marked = rows.join(end, series).where(F.col(seconds) <= F.greatest(F.col("t_end") - span, F.lit(0.0)))
    anchor = marked.groupBy(series).agg(F.max(seconds).alias("t_then"), F.max_by(count, seconds).alias("then"))
    joined = end.join(anchor, series, "left")
    passed, gained = F.col("t_end") - F.coalesce("t_then", F.lit(0.0)), F.col("last") - F.coalesce("then", F.lit(0))
    return joined.select(series, "t_end", "last", F.coalesce("then", F.lit(0)).alias("then"), F.coalesce(F.try_divide(gained, passed), F.lit(0.0)).alias("rate"))


def downsample(rows: DataFrame, label: str, limit: int = 24, *, series: str = "series_id", order: str = "ord") -> DataFrame:
    """At most `limit` rows a series: first, last, each change of label, and others evenly spread; more only for changes."""
    dealt = scan.previous(scan.ranged(rows, [series], [order]), [series], [order], {"__last": label})
    dealt = scan.running(dealt, [series], [order], sums={"__i": F.lit(1).cast("long")})
    ends = dealt.groupBy(series).agg(F.max("__i").alias("__n"))
    fresh = (F.col("__i") == 1) | ~F.col(label).eqNullSafe(F.col("__last"))
    marked = dealt.join(ends, series).withColumn("__must", (fresh | (F.col("__i") == F.col("__n"))).cast("long"))
    marked = scan.running(marked, [series], [order], sums={"__k": 1 - F.col("__must")})
    needed = marked.groupBy(series).agg(F.sum("__must").alias("__req"))
    marked = marked.join(needed, series).withColumn("__k", F.col("__k") - 1)
    free, slots = F.col("__n") - F.col("__req"), F.least(limit - F.col("__req"), F.col("__n") - F.col("__req"))
    # Place p of the spread takes the optional row floor((p + 1) * free / (slots + 1)).
    p = F.floor((F.col("__k") * (slots + 1) + free - 1) / F.when(free > 0, free))
    taken = (slots > 0) & F.exists(F.array(p - 1, p, p + 1), lambda x: (x >= 1) & (x <= slots) & (F.floor(x * free / (slots + 1)) == F.col("__k")))
    kept = (F.col("__n") <= limit) | (F.col("__must") == 1) | F.coalesce(taken, F.lit(False))
    return marked.where(kept).select(*rows.columns)


def trailing_sum(rows: DataFrame, seconds: str, value: str, span: int = 30, *, series: str = "series_id") -> DataFrame:
    """The sum over the last `span` seconds, the row's own included."""
    return scan.trailing(rows, series, seconds, span, {"trailing": value})


def zero_gap(rows: DataFrame, seconds: str, *, series: str = "series_id") -> DataFrame:
    """The longest time between neighbouring rows of each series."""
    with_before = scan.previous(scan.ranged(rows, [series], [seconds]), [series], [seconds], {"__then": seconds})
    return with_before.groupBy(series).agg(F.max(F.col(seconds) - F.col("__then")).alias("max_gap"))


def funnel(events: DataFrame, user: str, stage: str, stages: tuple[str, ...]) -> DataFrame:
    """stage, users that reached it and all stages before, and their share of the first stage's."""
    reached = events.where(F.col(stage).isin(*stages)).groupBy(user).agg(F.collect_set(stage).alias("seen"))
    counts = [F.count(F.when(F.forall(F.array(*map(F.lit, stages[: n + 1])), lambda s: F.array_contains(F.col("seen"), s)), 1)).alias(s) for n, s in enumerate(stages)]
    row = reached.agg(*counts)
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("users"), F.try_divide(F.col(s), F.col(stages[0])).alias("share")) for s in stages])).alias("place", "it")).select("place", "it.*")


def funnel_faults(rows: DataFrame, place: str = "place", count: str = "users") -> DataFrame:
    """Stages that hold more than the one before. A funnel is a handful of rows."""
    before = F.lag(count).over(Window.orderBy(place))
    return rows.withColumn("__before", before).where(F.col(count) > F.col("__before")).drop("__before")


def saturated(rounds: DataFrame) -> DataFrame:
    """One row: whether the last three rounds (ord) brought nothing new, from three families and three classes."""
    last = rounds.orderBy(F.desc("ord")).limit(3)
    empty = (F.col("new_valid_urls") == 0) & (F.col("new_entities") == 0) & (F.col("new_fields") == 0) & F.col("mostly_duplicates")
    whole = F.count(F.lit(1)) == 3
    return last.agg((whole & F.coalesce(F.bool_and(empty), F.lit(False)) & (F.countDistinct(F.lower("query_family")) == 3) & (F.countDistinct(F.lower("source_class")) == 3)).alias("saturated"))
