"""Versioned tables: readers, writers and crashes between any two steps."""

import threading

import pytest

from plumbline.sources.versions import ConflictError, Versions, digest


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_readers_see_whole_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/store")
    assert v.version() == 0 and v.tables() == {}
    assert v.publish({"a": spark.range(3), "b": spark.range(1)}) == 1
    old = v.read("a")
    staged = v.stage({"a": spark.range(5)})  # a writer that has not committed
    assert ids(v.read("a")) == [0, 1, 2]
    assert v.commit(staged, 1) == 2
    assert ids(old) == [0, 1, 2] and ids(v.read("a")) == [0, 1, 2, 3, 4] and ids(v.read("b")) == [0] and ids(v.read("a", 1)) == [0, 1, 2]
    assert v.publish({"b": spark.range(0)}) == 3 and ids(v.read("b")) == [] and v.read("b").columns == ["id"]


def test_one_of_two_writers_wins(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/store")
    v.publish({"a": spark.range(1)})
    first, second = v.stage({"a": spark.range(2)}), v.stage({"a": spark.range(3)})
    assert v.commit(first, 1) == 2
    with pytest.raises(ConflictError):
        v.commit(second, 1)
    assert ids(v.read("a")) == [0, 1] and not [n for n in v._names("versions") if n.startswith(".")]
    with pytest.raises(ConflictError):
        v.publish({"a": spark.range(9)}, after=1)
    told = []

    def write(n):
        try:
            told.append(v.publish({"a": spark.range(n)}, after=2))
        except ConflictError:
            told.append(None)

    writers = [threading.Thread(target=write, args=(n,)) for n in (4, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert 3 in told and v.version() == 3 and len(ids(v.read("a"))) in (4, 5)


@pytest.mark.parametrize("step", ["stage", "create", "rename"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    v = Versions(spark, f"file://{tmp_path}/store")
    v.publish({"a": spark.range(2), "b": spark.range(2)})

    def stop(*_):
        raise KeyboardInterrupt

    if step == "stage":
        with pytest.raises(KeyboardInterrupt):
            monkeypatch.setattr(Versions, "commit", stop)
            v.publish({"a": spark.range(7)})
    elif step == "create":
        (tmp_path / "store/versions/.half").write_text('{"a": ')
    else:
        v.stage({"a": spark.range(7), "b": spark.range(7)})
    monkeypatch.undo()
    fresh = Versions(spark, f"file://{tmp_path}/store")
    assert fresh.version() == 1 and ids(fresh.read("a")) == ids(fresh.read("b")) == [0, 1]
    assert fresh.publish({"a": spark.range(3)}) == 2
    fresh.clean(1)
    assert ids(fresh.read("a")) == [0, 1, 2] and ids(fresh.read("b")) == [0, 1] and len(list((tmp_path / "store/data").iterdir())) == 2


def test_checks_and_plans(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/store")
    v.publish({"a": spark.range(4), "b": spark.range(2)})
    orphan = lambda t: t["b"].join(t["a"], "id", "left_anti")
    with pytest.raises(ValueError, match="not published"):
        v.publish({"b": spark.range(6)}, check=orphan)
    assert v.version() == 1 and len(v._names("data")) == 1
    source = {"a": digest(v.read("a"))}
    assert digest(v.read("a")) == digest(v.read("a").orderBy("id", ascending=False).repartition(3)) != digest(v.read("b"))
    assert v.apply(lambda t: {"b": t["a"].where("id > 1")}, source, check=orphan) == 2 and ids(v.read("b")) == [2, 3]
    v.publish({"a": spark.range(5)})
    with pytest.raises(ConflictError, match="source changed"):
        v.apply(lambda t: {"b": t["a"]}, source)
    kinds = spark.sql("select map('k', 1) as m, array(1, null) as l, cast(null as string) as s, struct(1 as x) as t")
    assert digest(kinds) == digest(kinds) and digest(kinds.limit(0)).startswith("0-0-")
