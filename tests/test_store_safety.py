"""What two processes on one store, open snapshots and open transactions may rely on."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import codecs
from palimpsest.operators import compact as C
from palimpsest.operators import merge_ops as M
from palimpsest.operators import seqtime
from palimpsest.operators import visible as V
from palimpsest.operators.log import LogError
from palimpsest.settings import Settings
from palimpsest.sources.store import Conflict, Fenced, Store
from palimpsest.streaming import cdc

from .test_semantics import LOG, random_rows


def store(spark, root, **options):
    return Store(spark, str(root), M.SUM, key=T.LongType(), value=T.LongType(), **options)


def state(s, **options):
    return {r.key: r.value for r in s.scan(**options).collect()}


def test_two_writers_on_one_manifest(spark, tmp_path, monkeypatch):
    a, b = store(spark, tmp_path / "a").open_writer(), None
    b = store(spark, a.root)
    b.epoch = a.epoch
    m = b._checked()
    a.put(1, 10)
    monkeypatch.setattr(b, "_checked", lambda: m)  # b still holds the manifest from before a's write
    with pytest.raises(Fenced):
        b.put(2, 20)
    assert state(a) == {1: 10} and [w["number"] for w in a.manifest().wal] == [1]
    assert len(a.files.names(f"{a.root}/wal")) == 1  # the loser's batch is gone, the winner's is not touched
    assert [n for n, _ in cdc.batches(a)] == [1]


def test_a_put_between_check_and_commit(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    t = s.begin()
    t.put(1, 100)
    real, calls = t._conflicts, []

    def slow(m):
        found = real(m)
        if not calls:
            calls.append(s.put(1, 50))  # after the check, before the append
        return found

    monkeypatch.setattr(t, "_conflicts", slow)
    with pytest.raises(Conflict):
        t.commit()
    assert state(s) == {1: 50}
    t.rollback()
    assert not s.manifest().checkpoints
    with pytest.raises(LogError):
        t.commit()


def test_a_write_elsewhere_between_check_and_commit(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    t = s.begin()
    t.put(1, 100)
    real, calls = t._conflicts, []

    def slow(m):
        found = real(m)
        if not calls:
            calls.append(s.put(2, 50))
        return found

    monkeypatch.setattr(t, "_conflicts", slow)
    assert t.commit() > calls[0] and state(s) == {1: 100, 2: 50}


def test_a_delete_that_was_compacted_is_still_a_conflict(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    s.put(2, 2)
    s.flush()
    t = s.begin()
    t.put(1, 100)
    s.delete(1)
    s.flush()
    s.compact()
    assert state(s) == {2: 2}
    with pytest.raises(Conflict):
        t.commit()
    t.rollback()
    s.put(3, 3)
    s.flush()
    s.compact()
    assert s.log().where("key = 1").count() == 0  # nobody needs the tombstone any more


def test_snapshots_hold_back_flush_and_compaction(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    for k in (1, 2):
        s.put(k, k)
    with s.snapshot() as view:
        for _ in range(2):
            s.put(1, 50)
            s.merge_in(1, 7)
            s.delete(2)
            s.flush()
        s.compact()
        s.collect_garbage(0)
        assert {r.key: r.value for r in view.scan().collect()} == {1: 1, 2: 2} and state(s) == {1: 57}
        assert view.get(2).first().value == 2
    s.put(4, 4)
    s.flush()
    s.compact()
    assert s.log().count() == 2  # the old versions are gone


def test_expired_snapshots_hold_nothing(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    s.create_checkpoint("old", lifetime_ms=5, now_ms=0)
    s.put(1, 2)
    s.flush()
    assert s.log().count() == 1


def test_reader_and_named_clone(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    s.flush()
    s.create_checkpoint("one")
    r = s.reader()
    s.put(1, 2)
    s.flush()
    s.compact()
    assert r.get(1).first().value == 1 and r.refresh().get(1).first().value == 2
    other = s.clone(str(tmp_path / "b"), "one")
    s.delete_checkpoint("one")
    r.close()
    s.collect_garbage(0)
    assert state(other) == {1: 1} and state(s) == {1: 2}


def test_garbage_of_a_flush_in_progress_stays(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    s.put(1, 1)
    made = s._store(s.log(), 0, None, s.manifest())  # written, not yet in a manifest
    assert s.collect_garbage() == [] and s.spark.read.parquet(made[0]["path"]).count() == 1
    assert made[0]["path"] in s.collect_garbage(0, dry_run=True)


def test_settings_are_in_force(spark, tmp_path):
    s = store(spark, tmp_path / "a", settings=Settings(default_ttl_ms=1000, most_unflushed=2, most_level0=2, least_sources=2))
    w = s.put(1, 1)
    row = s.get(1).first()
    assert w == 1 and row.expire_ts == w.create_ts + 1000 and row.create_ts == w.create_ts
    s.put(1, 1, ttl=None)
    assert s.get(1).first().expire_ts is None and len(s.manifest().unflushed()) == 2
    s.put(1, 5, ttl=7)
    assert len(s.manifest().unflushed()) == 1 and len(s.manifest().files) == 1
    for k in range(4):
        s.put(k, k, ttl=None)
    m = s.manifest()
    assert any(f["level"] for f in m.files) and sum(not f["level"] for f in m.files) <= 2 and state(s)[3] == 3
    assert s.scheduler.least == 2
    ops = spark.createDataFrame([(0, "put", 8, 1, "default", None), (1, "put", 9, 1, "no_expiry", None), (2, "put", 10, 1, "after_ms", 5)], "op_idx int, op string, key long, value long, ttl_kind string, ttl_value long")
    s.write(ops, now_ms=100)
    assert {k: s.get(k).first().expire_ts for k in (8, 9, 10)} == {8: 1100, 9: None, 10: 105}
    assert s.get(8, remote=True).count() == 1 and s.get(8, seq=1).count() == 0 and s.get(8, dirty=True).count() == 1


def test_follow_serves_committed_batches_only(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    for k in range(3):
        s.put(k, k)
    s.log().write.parquet(f"{s.root}/wal/{4:020d}-orphan")  # finished, but in no manifest
    q = cdc.follow(s).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert sorted((r.batch, r.key) for r in spark.sql("select * from followed").collect()) == [(1, 0), (2, 1), (3, 2)]


@pytest.mark.parametrize("name", ["append_list", "concat", "count", "set_union"])
def test_operators_are_closed_under_collapse(spark, name):
    op = M.REGISTRY[name]
    raw = spark.createDataFrame(random_rows(random.Random(3), 80), LOG)
    log = op.entered(raw.withColumn("value", F.col("value").cast("string")) if name == "concat" else raw)
    want = {r.key: r.value for r in V.visible(log, op).collect()}
    twice = C.compact([C.flush(log.where("seq <= 30"), op, barrier=40), log.where("seq > 30")], op, barrier=40, min_seq=40, oldest=True)
    assert {r.key: r.value for r in V.visible(twice, op).collect()} == want


def test_codecs_of_null_and_long_values(spark):
    df = spark.createDataFrame([(None, b"ab"), (float("nan"), None), (1.5, b"abc"), (-0.0, b"")], "x double, b binary")
    rows = df.select("x", codecs.f64("x").alias("k"), codecs.f64_decode(codecs.f64("x")).alias("y")).collect()
    assert [r.k is None for r in rows] == [True, False, False, False] and math.isnan(rows[1].y) and rows[2].y == 1.5 and bytes(rows[1].k).hex() == "fff8000000000000"
    assert [r.n for r in df.where("b is null or octet_length(b) < 3").select(F.octet_length(codecs.fixed(F.col("b"), 2)).alias("n")).collect()] == [2, None, 2]
    with pytest.raises(PySparkException):
        df.select(codecs.fixed(F.col("b"), 2)).collect()


def test_as_of_lookups(spark):
    tracker = spark.createDataFrame([(10, 100), (20, 200), (30, 300)], "seq long, ts long")
    probes = spark.createDataFrame([(5,), (10,), (15,), (30,), (31,), (None,), (15,)], "seq long")
    up = {r.seq: r.ts for r in seqtime.seq_to_ts(probes, tracker).collect()}
    down = {r.seq: r.ts for r in seqtime.seq_to_ts(probes, tracker, up=False).collect()}
    assert up == {5: 100, 10: 100, 15: 200, 30: 300, 31: None, None: None} and down == {5: None, 10: 100, 15: 100, 30: 300, 31: 300, None: None}
    assert {r.ts for r in seqtime.seq_to_ts(probes, tracker.limit(0)).collect()} == {None}
    with pytest.raises(LogError):
        seqtime.seq_to_ts(probes, spark.range(9000).selectExpr("id as seq", "id as ts"))
