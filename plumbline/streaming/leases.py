"""Channels of work with leased tasks, pressure on their concurrency and queries to make up for: keyed state with timers.

A channel (a backend with its adapter) keeps its tasks, its concurrency and the queries that failed. The rules are one class,
Channel, over any map of tasks and queries. channel_fold() runs it over recorded events as a sorted stream;
channel_stream() runs it in Structured Streaming, where Spark keeps the maps, and event-time timers end leases.

events: channel, adapter, ord, at (timestamp), kind and what the kind needs:
  lease (task_id, lease_id, seconds)   the task is worked on until its time is over
  done, failed (task_id, lease_id)     the lease ends; a lease that is over, or another one, tells nothing
  session (session_id)                 a new clock: leases of earlier sessions are interrupted and may be taken again
  signal (rate_limited, rate_limit_streak, error_rate, latency_ratio, captcha_rate, empty_body_rate, tool_limit, host_limit)
  missed, made_up (query_id)           a query that failed is to be made up for, once, until it is

Outputs: channel, ord, about (task, tier or query), id, status. A signal tells of its own channel alone.

Defined cases: events of one channel act in order of at, then ord; in the stream, in this order within a micro-batch. Null
rates are 0, null limits none. Finished tasks and queries that were made up leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.folds import sorted_fold
from plumbline.streaming.controllers import ERROR_PRESSURE, LATENCY_PRESSURE, STREAK, TIERS, Backend, Signal, next_state

OUT = "channel string, ord long, about string, id string, status string"
EVENTS = "channel string, adapter string, ord long, at timestamp, kind string, task_id string, lease_id string, seconds double, session_id string, rate_limited boolean, rate_limit_streak int, error_rate double, latency_ratio double, captcha_rate double, empty_body_rate double, tool_limit int, host_limit int, query_id string"


class Lease(NamedTuple):
    """A task that is worked on, or was interrupted."""

    status: str
    lease_id: str
    until: float
    session: str


class Channel:
    """The rules over a channel's tasks and queries; state is its concurrency and session."""

    def __init__(self, name: str, tasks: MutableMapping[str, Lease], queries: MutableMapping[str, int], state: Backend | None = None, session: str = ""):
        self.name, self.tasks, self.queries = name, tasks, queries
        self.state, self.session = state or Backend(), session

    def expire(self, now: float, ord_: int) -> list[tuple]:
        """Leases whose time is over by now are interrupted."""
        over = sorted(t for t, lease in list(self.tasks.items()) if lease.status == "leased" and lease.until <= now)
        for t in over:
            self.tasks[t] = self.tasks[t]._replace(status="interrupted")
        return [(self.name, ord_, "task", t, "interrupted") for t in over]

    def tell(self, event: dict[str, Any]) -> list[tuple]:
        """What an event changes, after the leases that were over by then."""
        at = event["at"].timestamp()
        return [*self.expire(at, event["ord"]), *getattr(self, f"_{event['kind']}")(event, at)]

    def _lease(self, e, at):
        held = self.tasks.get(e["task_id"])
        if held is not None and held.status == "leased":
            return [(self.name, e["ord"], "task", e["task_id"], "refused")]
        self.tasks[e["task_id"]] = Lease("leased", e["lease_id"], at + (e["seconds"] or 0.0), self.session)
        return [(self.name, e["ord"], "task", e["task_id"], "leased")]

    def _ended(self, e, status):
        held = self.tasks.get(e["task_id"])
        if held is None or held.status != "leased" or held.lease_id != e["lease_id"]:
            return [(self.name, e["ord"], "task", e["task_id"], "stale")]
        del self.tasks[e["task_id"]]
        return [(self.name, e["ord"], "task", e["task_id"], status)]

    def _done(self, e, at):
        return self._ended(e, "done")

    def _failed(self, e, at):
        return self._ended(e, "failed")

    def _session(self, e, at):
        self.session = e["session_id"]
        old = sorted(t for t, lease in list(self.tasks.items()) if lease.status == "leased" and lease.session != self.session)
        for t in old:
            self.tasks[t] = self.tasks[t]._replace(status="interrupted")
        return [(self.name, e["ord"], "task", t, "interrupted") for t in old]

    def _signal(self, e, at):
        rate = lambda name: e[name] or 0.0
        page = e["adapter"] == "page" and (rate("captcha_rate") > 0 or rate("empty_body_rate") > 0)
        limited, streak = bool(e["rate_limited"]) or page, max(e["rate_limit_streak"] or 0, STREAK if page else 0)
        heavy = (limited and streak >= STREAK) or max(rate("error_rate"), ERROR_PRESSURE if page else 0.0) >= ERROR_PRESSURE or (e["latency_ratio"] or 1.0) >= LATENCY_PRESSURE
        limit = min((x for x in (e["tool_limit"], e["host_limit"]) if x is not None), default=TIERS[-1])
        self.state, action = next_state(self.state, Signal(self.name, e["ord"], limit, limited, heavy, True, 0))
        return [(self.name, e["ord"], "tier", str(self.state.tier), action)]

    def _missed(self, e, at):
        if e["query_id"] in self.queries:
            return []
        self.queries[e["query_id"]] = e["ord"]
        return [(self.name, e["ord"], "query", e["query_id"], "to make up")]

    def _made_up(self, e, at):
        if self.queries.pop(e["query_id"], None) is None:
            return []
        return [(self.name, e["ord"], "query", e["query_id"], "made up")]


def channel_fold(events: DataFrame) -> DataFrame:
    """Over recorded events: what each of them changes."""
    return sorted_fold(events, ["channel"], ["at", "ord"], OUT, begin=lambda e: Channel(e["channel"], {}, {}), row=lambda channel, e: (channel, channel.tell(e)))


class _Kept(MutableMapping):
    """A map state of Spark's as a Python map."""

    def __init__(self, state, shape):
        self.state, self.shape = state, shape

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.shape(*self.state.getValue((key,)))

    def __setitem__(self, key, value):
        self.state.updateValue((key,), tuple(value) if isinstance(value, tuple) else (value,))

    def __delitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        self.state.removeKey((key,))

    def __iter__(self):
        return iter([k[0] for k in self.state.keys()])

    def __len__(self):
        return sum(1 for _ in self)


class ChannelProcessor(StatefulProcessor):
    """Channel with its maps in Spark's state, and a timer for each lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", "status string, lease_id string, until double, session string")
        self.queries = handle.getMapState("queries", "query_id string", "ord long")
        self.held = handle.getValueState("channel", "tier int, recovering boolean, pressured boolean, session string")

    def _channel(self, key) -> Channel:
        *state, session = self.held.get() if self.held.exists() else (*Backend(), "")
        return Channel(key[0], _Kept(self.tasks, Lease), _Kept(self.queries, int), Backend(*state), session)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        channel, out = self._channel(key), []
        for e in pd.concat(list(rows)).sort_values(["at", "ord"]).to_dict("records"):
            e = {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in e.items()}
            out += channel.tell(e)
            if e["kind"] == "lease":
                self.handle.registerTimer(int(1000 * (e["at"].timestamp() + (e["seconds"] or 0.0))))
        self.held.update((*channel.state, channel.session))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(self._channel(key).expire(expiredTimerInfo.getExpiryTimeInMs() / 1000, -1))

    def close(self) -> None:
        pass


def channel_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream of events; a lease that is over tells by its timer (ord -1) or before the channel's next event.

    Needs spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    return events.withWatermark("at", delay).groupBy("channel").transformWithStateInPandas(statefulProcessor=ChannelProcessor(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
