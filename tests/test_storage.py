"""Snapshots, log, replication, runs, metrics, orphans."""

import pytest

from lithos import errors
from lithos.observe import MetricsDiff, MetricsSnapshot, PrometheusExporter
from lithos.operators.changeset import ChangeSet
from lithos.operators.transactions import Durable, Optimistic
from lithos.sources import lsm, snapshot, storage
from lithos.sources.wal import Wal, WalCursor
from lithos.world import World


def make(spark):
    w = World(spark)
    w.register("P", "struct<x:float,y:float>")
    w.register("A", "int")
    return w


def test_snapshot_round_trip(spark, tmp_path):
    w = make(spark)
    a, b = w.spawn(P=(1.0, 2.0), A=3), w.spawn(A=4)
    w.insert_sparse("S", {b: 9}, "int")
    w.despawn(w.spawn(A=1))
    snapshot.save(w, str(tmp_path / "s"))
    snapshot.save(w, str(tmp_path / "s"))
    got = snapshot.load(spark, str(tmp_path / "s"))
    assert got.get(a, "P").x == 1.0 and got.get(b, "S") == 9 and got.tick == w.tick
    assert got.spawn(A=1) == w.spawn(A=1)
    with pytest.raises(errors.FormatError):
        snapshot.load(spark, str(tmp_path / "s"), {"A": w.types["P"]})


def test_wal_replay_cursor_and_replication(spark, tmp_path):
    w, wal = make(spark), Wal(spark, str(tmp_path / "wal"), limit_bytes=1)
    strategy = Durable(Optimistic(), wal)
    e = strategy.transact(w, lambda tx: tx.spawn(A=1, P=(1.0, 2.0)))
    strategy.transact(w, lambda tx: tx.write(e, A=2))
    strategy.transact(w, lambda tx: None)
    assert wal.records() == [0, 1] and wal.checkpoint_needed()
    other = make(spark)
    assert wal.replay(other) == 1 and other.get(e, "A") == 2 and other.get(e, "P").y == 2.0
    replica, cursor = make(spark), WalCursor(wal)
    assert cursor.next_batch(1).apply(replica) == 0 and replica.get(e, "A") == 1
    assert cursor.next_batch(10).apply(replica) == 1 and cursor.next_batch(10) is None
    storage.write_text(spark, str(tmp_path / "wal" / "_tmp-2" / "x"), "torn")
    assert Wal(spark, str(tmp_path / "wal")).next_seq == 2
    wal.acknowledge_snapshot(0)
    assert wal.delete_before(1) == 1 and wal.records() == [1]
    with pytest.raises(errors.CursorBehind):
        WalCursor(wal).next_batch(1)
    assert wal.frame(1).count() == 1
    bare = World(spark)
    with pytest.raises(errors.FormatError):
        WalCursor(wal, 1).next_batch(1).apply(bare)


def test_failed_replay_raises(spark, tmp_path):
    w, wal = make(spark), Wal(spark, str(tmp_path / "w2"))
    c = ChangeSet()
    c.insert(5, A=1)
    wal.append(c, w)
    with pytest.raises(errors.DeadEntity):
        wal.replay(make(spark))


def test_lsm(spark, tmp_path):
    w, store = make(spark), lsm.LsmStore(spark, str(tmp_path / "lsm"))
    a = w.spawn(A=0)
    seen = 0
    assert len(store.flush(w, seen)) == 1
    for k in range(1, 4):
        seen = w.tick
        assert store.flush(w, seen) == []
        w.insert(a, A=k)
        w.spawn(A=10 + k)
        store.flush(w, seen)
    assert store.find_candidate() == (0, "A")
    assert [r.A for r in store.get("A", a).collect()] == [3]
    report = store.compact_one()
    assert report.input_run_count == 4 and report.output_bytes > 0 and store.find_candidate() is None
    assert sorted(r.A for r in store.scan("A").collect()) == [3, 11, 12, 13]
    again = lsm.LsmStore(spark, str(tmp_path / "lsm"))
    assert again.runs == store.runs
    assert len(again.cleanup_orphans()) == 4 and again.cleanup_orphans() == []


def test_metrics(spark):
    w = make(spark)
    first = MetricsSnapshot.capture(w)
    a = w.spawn(A=1)
    w.spawn(A=1, P=(0.0, 0.0))
    w.despawn(a)
    second = MetricsSnapshot.capture(w)
    d = MetricsDiff.compute(first, second)
    assert (d.entity_delta, d.churn, d.archetype_delta) == (1, 3, 2)
    x = PrometheusExporter()
    assert x.render() == ""
    x.update(first)
    x.update(second)
    text = x.render()
    assert text.count("# TYPE") == 15 and "lithos_entities 1\n" in text and 'archetype="A+P"' in text


def test_orphans(spark):
    dead = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [r[0] for r in snapshot.orphans(dead, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]


def test_checkpoint_and_recovery(spark, tmp_path):
    from lithos.sources.checkpoint import AutoCheckpoint, recover, release

    wal = Wal(spark, str(tmp_path / "log"), limit_bytes=1, on_checkpoint=AutoCheckpoint(str(tmp_path / "snap")))
    w, strategy = make(spark), None
    strategy = Durable(Optimistic(), wal)
    e = strategy.transact(w, lambda tx: tx.spawn(A=1))
    assert wal.records() == []
    wal.on_checkpoint = None
    strategy.transact(w, lambda tx: tx.write(e, A=7))
    got = recover(spark, str(tmp_path / "snap"), Wal(spark, str(tmp_path / "log")), make(spark))
    assert got.get(e, "A") == 7

    class Store:
        def on_orphaned(self, keys):
            self.keys = [r[0] for r in keys.collect()]

    s = Store()
    release(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",)], "k string"), "k", s)
    assert s.keys == ["a"]


def test_replace_restores_and_settles(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    storage.write_text(spark, at("a"), "old")
    with pytest.raises(OSError):
        storage.replace(spark, at("missing"), at("a"))
    assert storage.read_text(spark, at("a")) == "old" and not storage.exists(spark, at("a.old"))
    storage.write_text(spark, at("b"), "new")
    storage.replace(spark, at("b"), at("a"))
    assert storage.read_text(spark, at("a")) == "new" and not storage.exists(spark, at("a.old"))
    storage.move(spark, at("a"), at("a.old"))  # as a crash between the renames leaves it
    assert storage.settled(spark, at("a")) and storage.read_text(spark, at("a")) == "new" and not storage.settled(spark, at("c"))


def test_crash_in_the_midst_of_a_manifest(spark, tmp_path):
    w, store = make(spark), lsm.LsmStore(spark, str(tmp_path / "lsm"))
    w.spawn(A=1)
    store.flush(w, 0)
    storage.move(spark, str(tmp_path / "lsm" / "manifest.jsonl"), str(tmp_path / "lsm" / "manifest.jsonl.old"))
    again = lsm.LsmStore(spark, str(tmp_path / "lsm"))
    assert again.runs == store.runs and again.cleanup_orphans() == []


def test_query_writers_are_logged_and_recovered(spark, tmp_path):
    from pyspark.sql import functions as F

    from lithos.operators.reducers import ReducerRegistry
    from lithos.sources.checkpoint import recover
    from lithos.world import Mut

    w, wal = make(spark), Wal(spark, str(tmp_path / "log"))
    strategy, r = Durable(Optimistic(), wal), ReducerRegistry()
    r.register("grow", "query_writer", lambda q, by: q.modify(A=F.col("A") + by, P=F.col("P")), Mut("A"), Mut("P"))
    e = strategy.transact(w, lambda tx: tx.spawn(A=1, P=(float("nan"), 2.0)))
    n = strategy.transact(w, lambda tx: tx.spawn(A=None, P=None))
    r.call(strategy, w, "grow", by=5)
    assert wal.records() == [0, 1, 2] and w.get(e, "A") == 6
    got = recover(spark, str(tmp_path / "none"), Wal(spark, str(tmp_path / "log")), make(spark))
    assert got.get(e, "A") == 6 and got.get(e, "P").y == 2.0 and got.get(e, "P").x != got.get(e, "P").x and got.get(n, "A") is None and got.get(n, "P") is None
