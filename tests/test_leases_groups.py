"""Leases, channels and ordered commits, as a fold, as a stream with timers, and over crashes and replays."""

import datetime as dt

import pytest

from plumbline.sources.versions import ConflictError, Versions
from plumbline.streaming import groups, leases

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
NAMES = [c.strip().split()[0] for c in leases.EVENTS.split(",")]


def event(channel, ord_, at, kind, **more):
    row = {"channel": channel, "adapter": "page" if channel == "web" else "api", "ord": ord_, "at": START + dt.timedelta(seconds=at), "kind": kind} | more
    return tuple(row.get(n) for n in NAMES)


ROWS = [
    event("web", 1, 0, "session", session_id="s1"), event("api", 1, 0, "session", session_id="s1"),
    event("web", 2, 1, "lease", task_id="a", lease_id="x", seconds=60.0), event("web", 3, 2, "lease", task_id="b", lease_id="y", seconds=5.0),
    event("web", 4, 3, "lease", task_id="a", lease_id="z", seconds=9.0), event("api", 2, 3, "lease", task_id="a", lease_id="q", seconds=500.0),
    event("web", 5, 10, "done", task_id="b", lease_id="y"), event("web", 6, 11, "session", session_id="s2"),
    event("web", 7, 12, "done", task_id="a", lease_id="x"), event("web", 8, 13, "lease", task_id="a", lease_id="w", seconds=50.0),
    event("web", 9, 14, "done", task_id="a", lease_id="w"), event("web", 10, 15, "signal", captcha_rate=0.5), event("api", 3, 15, "signal", captcha_rate=0.5),
    event("web", 11, 16, "missed", query_id="k"), event("web", 12, 17, "missed", query_id="k"), event("web", 13, 18, "made_up", query_id="k"), event("web", 14, 19, "made_up", query_id="k"),
    event("api", 4, 20, "done", task_id="a", lease_id="q"),
]

WANT = {
    "web": [(2, "task", "a", "leased"), (3, "task", "b", "leased"), (4, "task", "a", "refused"), (5, "task", "b", "interrupted"), (5, "task", "b", "stale"), (6, "task", "a", "interrupted"), (7, "task", "a", "stale"), (8, "task", "a", "leased"), (9, "task", "a", "done"), (10, "tier", "16", "backoff"), (11, "query", "k", "to make up"), (13, "query", "k", "made up")],
    "api": [(2, "task", "a", "leased"), (3, "tier", "32", "scale-up"), (4, "task", "a", "done")],
}


def test_fold(spark):
    got = {c: [tuple(r)[1:] for r in leases.channel_fold(spark.createDataFrame(ROWS, leases.EVENTS)).collect() if r.channel == c] for c in WANT}
    assert got == WANT
    assert leases.channel_fold(spark.createDataFrame([], leases.EVENTS)).count() == 0


def test_stream_keeps_state_and_fires_timers(spark, tmp_path):
    """Three micro-batches; the lease of b ends by its timer once the watermark has passed, before any event says so."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = str(tmp_path / "in")
        stream = leases.channel_stream(spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).parquet(at + "/*"))
        parts = [ROWS[:6], [event("api", 9, 8, "missed", query_id="t")], ROWS[6:]]
        got = []
        for n, part in enumerate(parts):
            spark.createDataFrame(part, leases.EVENTS).coalesce(1).write.parquet(f"{at}/{n}")
            run = stream.writeStream.foreachBatch(lambda rows, batch: got.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
        web = [r[1:] for r in got if r[0] == "web"]
        assert (-1, "task", "b", "interrupted") in web
        assert sorted(r for r in web if r[0] > 0) == sorted(r for r in WANT["web"] if r != (5, "task", "b", "interrupted"))
        assert sorted(r[1:] for r in got if r[0] == "api" and r[1] != 9) == sorted(WANT["api"])
    finally:
        spark.conf.unset(key)


TASK = "task_id string, ord long, attempt int, ok boolean"


def test_ordered_commit(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "task_id string, attempt int, value string")
    tasks = lambda *t: spark.createDataFrame(list(t), TASK)
    # c failed: d, though done, has to wait. b gives no rows, a two.
    first = tasks(("a", 1, 1, True), ("b", 2, 1, True), ("c", 3, 1, False), ("d", 4, 1, True))
    assert groups.commit_group(store, first, rows(("a", 1, "x"), ("a", 1, "y"), ("d", 1, "w"), ("c", 1, "half"))) == 2
    assert sorted((r.task_id, r.value, r.ord) for r in store.read("rows").collect()) == [("a", "x", 1), ("a", "y", 1)]
    assert groups.commit_group(store, first, rows(("a", 1, "x"))) == 0 and store.version() == 1  # a replay
    again = tasks(("a", 1, 2, True), ("b", 2, 2, True), ("c", 3, 2, True), ("c", 3, 3, True), ("d", 4, 1, True))
    staged_only = Versions(spark, f"file://{tmp_path}/ledger")
    staged_only.stage({"rows": rows(("z", 1, "lost"))})  # a run that died before its commit
    assert groups.commit_group(store, again, rows(("a", 2, "again"), ("c", 2, "v"), ("c", 3, "second"), ("d", 1, "w"))) == 2
    assert sorted((r.task_id, r.value) for r in store.read("rows").collect()) == [("a", "x"), ("a", "y"), ("c", "v"), ("d", "w")]
    assert [r.task_id for r in store.read("tasks").orderBy("ord").collect()] == ["a", "b", "c", "d"]
    assert groups.commit_group(store, tasks(), rows()) == 0


def test_two_commits_of_one_base(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"file://{tmp_path}/ledger")
    tasks, rows = spark.createDataFrame([("a", 1, 1, True)], TASK), spark.createDataFrame([("a", 1, "x")], "task_id string, attempt int, value string")
    monkeypatch.setattr(Versions, "version", lambda self: 0)  # both saw the empty ledger
    assert groups.commit_group(store, tasks, rows) == 1
    with pytest.raises(ConflictError):
        groups.commit_group(store, tasks, rows)
    monkeypatch.undo()
    assert store.read("rows").count() == 1
