"""Reads, compaction, transactions and the store against plain Python folds and small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import codecs
from palimpsest.functions.ranges import KeyRange, excluded, included, successor
from palimpsest.operators import compact as C
from palimpsest.operators import merge_ops as M
from palimpsest.operators import segments as G
from palimpsest.operators import seqtime
from palimpsest.operators import visible as V
from palimpsest.operators.log import LogError, violations
from palimpsest.plans.size_tiered import Proposal, SizeTiered, Source, Tree
from palimpsest.sources.store import Conflict, Fenced, Store
from palimpsest.streaming import cdc

LOG = "key long, kind string, value long, seq long, create_ts long, expire_ts long"


def random_rows(rng, n=60, keys=5):
    rows = []
    for seq in range(1, n + 1):
        kind = rng.choice("VVMMMT")
        rows.append((rng.randrange(keys), kind, None if kind == "T" else rng.randrange(100), seq, seq * 10, None if kind == "T" or rng.random() < 0.5 else rng.choice([100, 300, 900])))
    return rows


def fold_visible(rows, seq):
    out = {}
    for key in {r[0] for r in rows}:
        state, meta = None, []
        for r in sorted((r for r in rows if r[0] == key and r[3] <= seq), key=lambda r: r[3]):
            if r[1] == "M":
                state = (state or 0) + r[2] if state is not None or r[2] is not None else None
                meta.append(r)
            else:
                state, meta = r[2], [r]
        if meta and meta[-1][1] != "T":
            expiry = [r[5] for r in meta if r[5] is not None]
            out[key] = (state, max(r[3] for r in meta), max(r[4] for r in meta), min(expiry) if expiry else None)
    return out


def fold_compaction(rows, barrier, now, min_seq, drop_tail):
    """Row by row over each key, newest first."""
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: -r[3])
        merged, i = [], 0
        while i < len(mine):
            group = [mine[i]]
            while group[-1][1] == "M" and i + 1 < len(mine) and not (barrier is not None and group[-1][3] > barrier) and mine[i + 1][5] == group[-1][5]:
                i += 1
                group.append(mine[i])
            i += 1
            if len(group) == 1:
                merged.append(group[0])
            else:
                kind = "V" if any(g[1] != "M" for g in group) else "M"
                merged.append((key, kind, sum(g[2] for g in group if g[2] is not None), group[0][3], max(g[4] for g in group), group[0][5]))
        kept = []
        for r in merged:
            dead = now is not None and r[5] is not None and r[5] <= now
            if r[1] == "M" and dead:
                continue
            last = r[1] != "M" and not (min_seq is not None and r[3] > min_seq)
            kept.append((key, "T", None, r[3], r[4], None) if r[1] == "V" and dead else r)
            if last:
                break
        while drop_tail and kept and kept[-1][1] == "T":
            kept.pop()
        out += kept
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_visible_state_is_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng)
    log = spark.createDataFrame(rows, LOG)
    for seq in (10, 35, 60):
        got = {r.key: (r.value, r.seq, r.create_ts, r.expire_ts) for r in V.visible(log, M.SUM, seq).collect()}
        assert got == fold_visible(rows, seq)


@pytest.mark.parametrize("seed", range(6))
def test_compaction_is_a_fold(spark, seed):
    rng = random.Random(100 + seed)
    rows = random_rows(rng)
    barrier, now, min_seq = rng.choice([None, 30]), rng.choice([None, 300]), rng.choice([None, 20])
    log = spark.createDataFrame(rows, LOG)
    narrow = C.retain(C.collapse(log, M.SUM, barrier, span=7), now, min_seq, seed % 2 == 0)
    assert sorted(map(str, (tuple(r) for r in narrow.collect()))) == sorted(map(str, fold_compaction(rows, barrier, now, min_seq, seed % 2 == 0)))
    got = sorted(tuple(r) for r in C.compact([log.where("seq % 2 = 0"), log.where("seq % 2 = 1")], M.SUM, now, barrier, min_seq, oldest=seed % 2 == 0).collect())
    assert sorted(map(str, got)) == sorted(map(str, fold_compaction(rows, barrier, now, min_seq, seed % 2 == 0)))


def test_spans_do_not_change_what_collapse_returns(spark):
    log = spark.createDataFrame(random_rows(random.Random(21)), LOG)
    for op in [*M.REGISTRY.values(), M.concat(","), M.max_by_version(lambda v: v % 3), M.custom(max, T.LongType())]:
        entered = op.entered(log.withColumn("value", log["value"].cast("string")) if op.name == "concat" else log)
        whole, narrow = ({(r.key, r.seq): tuple(r) for r in C.collapse(entered, op, 30, span=n).collect()} for n in (1 << 20, 5))
        assert whole == narrow, op.name


def test_compaction_keeps_what_is_visible(spark):
    log = spark.createDataFrame(random_rows(random.Random(9)), LOG)
    after = C.compact([log], M.SUM, barrier=30, min_seq=30, oldest=True)
    for seq in (30, 45, 60):
        a, b = ({r.key: r.value for r in V.visible(x, M.SUM, seq).collect()} for x in (log, after))
        assert a == b


def test_operand_without_operator(spark):
    log = spark.createDataFrame([(1, "V", 1, 1, None, None), (1, "M", 2, 2, None, None)], LOG)
    with pytest.raises(PySparkException):
        V.visible(log).collect()
    assert V.visible(log, seq=1).count() == 1


def test_merge_operators(spark):
    rows = [(1, "V", 5, 1, 1, None), (1, "M", 7, 2, 2, 50), (1, "M", 3, 3, 3, 40), (2, "M", 4, 4, 4, None), (3, "T", None, 5, 5, None)]
    log = spark.createDataFrame(rows, LOG)
    expected = {"sum": {1: 15, 2: 4}, "count": {1: 3, 2: 1}, "min": {1: 3, 2: 4}, "max": {1: 7, 2: 4}, "first": {1: 5, 2: 4}, "last": {1: 3, 2: 4}, "append_list": {1: [5, 7, 3], 2: [4]}, "concat": {1: "573", 2: "4"}}
    for name, want in expected.items():
        assert {r.key: r.value for r in V.visible(M.REGISTRY[name].entered(log), M.REGISTRY[name]).collect()} == want, name
    product = M.custom(lambda a, b: a * b, T.LongType())
    assert {r.key: r.value for r in V.visible(log, product).collect()} == {1: 105, 2: 4}
    assert V.get(log, 1, M.SUM).first().expire_ts == 40


def test_overlay_and_cursor(spark):
    log = spark.createDataFrame([(k, "V", k, k, k, None) for k in range(1, 9)], LOG)
    own = spark.createDataFrame([(1, "V", 50, 0, None, None, 0), (1, "M", 1, 0, None, None, 1), (2, "T", None, 0, None, None, 2), (9, "V", 9, 0, None, None, 3), (9, "T", None, 0, None, None, 4)], LOG + ", op_idx int")
    got = {r.key: r.value for r in V.overlay(log, own, 4, M.SUM).collect()}
    assert got == {1: 51, 3: 3, 4: 4}
    c = V.Cursor(log, KeyRange(included(2), excluded(7)))
    assert [r.key for r in c.seek(5).collect()] == [5, 6]
    for bad in (5, 7, 1):
        with pytest.raises(LogError):
            c.seek(bad)
    assert [r.key for r in V.scan(log, KeyRange(end=included(3)), descending=True).collect()] == [3, 2, 1]


def test_batch_collapse(spark):
    kind = "op_idx int, op string, key long, value long, expire_ts long"
    ops = spark.createDataFrame([(0, "put", 1, 5, None), (1, "merge", 1, 2, None), (2, "merge", 2, 1, 9), (3, "merge", 2, 1, 9), (4, "put", 3, 1, None), (5, "delete", 3, None, None)], kind)
    got = sorted((r.key, r.kind, r.value) for r in C.collapse_batch(ops, M.SUM, 4, 1).collect())
    assert got == [(1, "V", 7), (2, "M", 2), (3, "T", None)]
    with pytest.raises(PySparkException):
        C.collapse_batch(spark.createDataFrame([(0, "merge", 1, 1, 5), (1, "merge", 1, 1, 6)], kind), M.SUM, 4, 1).collect()


def test_ranges():
    assert successor(b"ab\xff") == b"ac" and successor(b"\xff\xff") is None and successor(b"") is None
    r = KeyRange.prefix(b"a", KeyRange(included(b"1"), excluded(b"3")))
    assert r.contains(b"a1") and r.contains(b"a2z") and not r.contains(b"a3") and not r.contains(b"b")
    assert KeyRange.prefix(b"").contains(b"\xff") and KeyRange.point(3).as_point() == 3
    with pytest.raises(ValueError):
        KeyRange(included(3), excluded(3))
    assert KeyRange(included(1), included(5)).intersect(KeyRange(excluded(5))) is None
    assert KeyRange(included(1), included(5)).intersect(KeyRange(included(5))).as_point() == 5


def test_prefix_bounds_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(b"a1", 1), (b"b1", 2)], "key binary, value int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(KeyRange.prefix(b"a").predicate("key"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and df.count() == 1


def test_codecs(spark):
    longs = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(x,) for x in longs], "x long").select("x", codecs.i64(F.col("x")).alias("k"))
    assert [r.x for r in df.orderBy("k").collect()] == longs
    assert all(r.x == r.y for r in df.select("x", codecs.i64_decode(F.col("k")).alias("y")).collect())
    assert [r.x for r in df.orderBy(codecs.descending(F.col("k"))).collect()] == longs[::-1]
    doubles = [float("-inf"), -2.5, -0.0, 0.0, 1e-300, 3.5, float("inf")]
    fd = spark.createDataFrame([(x,) for x in doubles], "x double").select("x", codecs.f64("x").alias("k"))
    assert [r.x for r in fd.orderBy("k").collect()] == doubles
    assert [r.y for r in fd.orderBy("k").select(codecs.f64_decode("k").alias("y")).collect()] == doubles
    parts = [b"", b"\x00", b"\x00\x01", b"\x01", b"a", b"a\x00", b"ab"]
    e = spark.createDataFrame([(p,) for p in parts], "p binary").select("p", codecs.escaped(F.col("p")).alias("k"))
    assert [bytes(r.p) for r in e.orderBy("k").collect()] == parts
    assert {bytes(r.k).hex() for r in e.where(F.hex("p") == "00").collect()} == {"00ff0000"}


def test_tracker(spark):
    assert seqtime.sample([(1, 0), (2, 30), (3, 60), (4, 119), (5, 120)]) == [(1, 0), (3, 60), (5, 120)]
    assert seqtime.sample([(i, 60 * i) for i in range(6)], capacity=4) == [(0, 0), (2, 120), (4, 240), (5, 300)]
    tracker = spark.createDataFrame([(10, 100), (20, 200)], "seq long, ts long")
    probes = spark.createDataFrame([(5,), (10,), (15,), (25,)], "seq long")
    up = {r.seq: r.ts for r in seqtime.seq_to_ts(probes, tracker).collect()}
    down = {r.seq: r.ts for r in seqtime.seq_to_ts(probes, tracker, up=False).collect()}
    assert up == {5: 100, 10: 100, 15: 200, 25: None} and down == {5: None, 10: 100, 15: 100, 25: 200}


def test_segments(spark):
    p = spark.createDataFrame([("a",), ("ab",), ("b",), ("bcd",)], "prefix string")
    assert sorted(tuple(r) for r in G.antichain_violations(p).collect()) == [("a", "ab"), ("b", "bcd")]
    f = spark.createDataFrame([(1, 5), (2, 3), (3, 9), (10, 11)], "lo int, hi int")
    assert G.overlap_depth(f).first().depth == 3
    log = spark.createDataFrame([(k, "V", k, k, k, None) for k in range(1, 9)], LOG)
    assert G.union_disjoint([log.where("key < 4"), log.where("key > 6")]).count() == 5
    with pytest.raises(LogError):
        G.union_disjoint([log.where("key < 4"), log.where("key > 2")])


def test_violations(spark):
    rows = [(1, "V", 1, 1, None, None), (1, "T", 1, 2, None, None), (1, "X", 1, 3, None, None), (1, "T", None, 4, None, 5)]
    assert sorted(r.rule for r in violations(spark.createDataFrame(rows, LOG)).collect()) == ["kind", "tombstone with expiry", "value"]


def test_scheduler():
    s = SizeTiered()
    files = [Source(f"f{i}", 10) for i in range(5)]
    assert s.propose([Tree("", files, [])], 0, 3) == [Proposal("", tuple(f.id for f in files), 3)]
    runs = [Source(i, size, True) for i, size in ((9, 1), (8, 2), (7, 3), (6, 4), (5, 400))]
    assert s.propose([Tree("", [], runs)], 0, 10) == [Proposal("", (9, 8, 7, 6), 6)]
    assert s.propose([Tree("", files, [])], 4, 3) == []
    with pytest.raises(ValueError):
        s.validate(Tree("", files, runs), Proposal("", ("f0", "f2"), 1))
    with pytest.raises(ValueError):
        s.validate(Tree("", files, runs), Proposal("", (9, 8), 9))


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"), M.SUM, key=T.LongType(), value=T.LongType()).open_writer()
    for k in range(6):
        s.put(k, 10 * k)
    c = s.create_checkpoint("first")
    s.merge_in(1, 5)
    s.delete(2)
    state = lambda store, **o: {r.key: r.value for r in store.scan(**o).collect()}
    now = {0: 0, 1: 15, 3: 30, 4: 40, 5: 50}
    assert state(s) == now and state(s, checkpoint="first") == {k: 10 * k for k in range(6)}
    s.flush()
    assert state(s) == now
    s.put(9, 90)
    s.flush()
    s.compact()
    now[9] = 90
    assert state(s) == now and state(s, checkpoint=c) == {k: 10 * k for k in range(6)}
    left, right = s.clone(str(tmp_path / "b"), clip="key < 4"), s.clone(str(tmp_path / "c"), clip="key >= 4")
    assert state(left) == {0: 0, 1: 15, 3: 30}
    assert state(Store.union(str(tmp_path / "d"), [left, right])) == now
    with pytest.raises(LogError):
        Store.union(str(tmp_path / "e"), [s, right])
    s.delete_checkpoint("first")
    would = s.collect_garbage(0, dry_run=True)
    assert would and state(s) == now
    s.collect_garbage(0)
    assert state(s) == now
    with pytest.raises(LogError):
        s.write(s._ops([("put", 1, 1, None)]), seq=1)
    other = Store(spark, s.root, M.SUM, key=T.LongType(), value=T.LongType()).open_writer()
    other.put(1, 1)
    with pytest.raises(Fenced):
        s.put(1, 2)


def test_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"), M.SUM, key=T.LongType(), value=T.LongType())
    for k in (1, 2):
        s.put(k, k)
    a, b = s.begin(), s.begin(serializable=True)
    a.put(1, 100)
    assert a.get(1).first().value == 100 and s.get(1).first().value == 1
    assert b.scan(KeyRange(included(5), included(9))).count() == 0
    b.put(2, 7)
    a.commit()
    s.put(6, 6)
    with pytest.raises(Conflict):
        b.commit()
    c = s.begin()
    c.put(1, 3)
    s.put(1, 4)
    with pytest.raises(Conflict):
        c.commit()
    c.unmark_write(1)
    assert c.commit() and s.get(1).first().value == 3


def test_change_capture(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"), M.SUM, key=T.LongType(), value=T.LongType())
    for k in range(4):
        s.put(k, k)
    seen = []
    cursor = cdc.consume(s, lambda df, n: seen.extend((n, r.key) for r in df.collect()))
    assert seen == [(n + 1, n) for n in range(4)] and cursor == 4
    s.put(9, 9)
    assert cdc.consume(s, lambda df, n: None, cursor) == 5
    s.flush()
    s.collect_garbage(0)
    s.put(10, 10)
    with pytest.raises(cdc.Truncated):
        cdc.consume(s, lambda df, n: None, 0)


def test_running_state(spark, tmp_path):
    rows = [(1, "V", 5, 1, 1, None), (1, "M", 7, 2, 2, None), (2, "V", 1, 3, 3, None), (2, "T", None, 4, 4, None), (3, "M", 2, 5, 5, None)]
    df = spark.createDataFrame(rows, LOG)
    df.write.parquet(str(tmp_path / "in"))
    stream = cdc.running_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda a, b: a + b, T.LongType())
    q = stream.writeStream.format("memory").queryName("running").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("select key, value, seq from running").collect()) == [(1, 12, 2), (3, 2, 5)]


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    root = str(tmp_path / "s")
    for k, v in (("a1", "x"), ("a2", "y"), ("b1", "z")):
        assert main(["put", root, k, v]) == 0
    main(["delete", root, "a2"])
    capsys.readouterr()
    main(["scan", root, "--prefix", "a"])
    assert capsys.readouterr().out == "a1\tx\n"
    main(["checkpoint", root, "now"])
    main(["flush", root])
    main(["scan", root, "--from", "0x61", "--values", "hex", "--max-keys", "1"])
    assert capsys.readouterr().out.endswith("a1\t0x78\n")


def test_filters_rule_out_files(spark, tmp_path):
    from palimpsest.functions.prefix import DelimitedPrefix, FixedPrefix
    from palimpsest.sources.filters import BloomPolicy, BoundsPolicy

    policies = [BoundsPolicy(), BloomPolicy(expected=1000), BloomPolicy(FixedPrefix(2), expected=1000)]
    s = Store(spark, str(tmp_path / "a"), key=T.BinaryType(), value=T.LongType(), policies=policies)
    for keys in ((b"aa1", b"zz1"), (b"ab1", b"zy1")):
        for k in keys:
            s.put(k, 1)
        s.flush()
    m = s.manifest()
    count = lambda r: len(s.pruned(m, r).files)
    assert count(KeyRange.point(b"aa1")) == 1 and count(KeyRange.point(b"mm")) == 0 and count(KeyRange.point(b"zzz")) == 0
    assert count(KeyRange.prefix(b"ab")) == 1 and count(KeyRange.prefix(b"q1")) == 0 and count(KeyRange()) == 2
    assert s.get(b"zy1").count() == 1 and s.scan(KeyRange.prefix(b"z")).count() == 2 and s.scan(replay=False).count() == 4
    d = DelimitedPrefix(b"\x00/")
    rows = spark.createDataFrame([(b"a\x00/b\x00/",), (b"\x10\x00\x2f",), (b"none",), (b"\x00\x02\xf0",)], "key binary")
    assert [r.p and bytes(r.p) for r in rows.select(d.column(F.col("key")).alias("p")).collect()] == [d.of(bytes(r.key)) for r in rows.collect()]
    assert d.shared(KeyRange.prefix(b"a\x00/")) == b"a\x00/" and d.shared(KeyRange.prefix(b"a")) is None


def test_segments_of_a_store(spark, tmp_path):
    from palimpsest.sources import inspect

    s = Store(spark, str(tmp_path / "a"), segment=lambda k: F.floor(k / 10), key=T.LongType(), value=T.LongType())
    for i in range(4):
        s.write(s._ops([("put", k, i, None) for k in (1, 11, 12, 21)]), now_ms=60_000 * i)
        s.flush()
    assert inspect.segments(s).count() == 3 and inspect.status(s).first().unflushed_batches == 0
    (proposal, *_) = SizeTiered().propose(s.trees(), 0, s.manifest().next_run)
    s.compact(proposal)
    assert {r.key: r.value for r in s.scan().collect()} == {1: 3, 11: 3, 12: 3, 21: 3}
    other = s.clone(str(tmp_path / "b"), segments=["1"])
    s.collect_garbage(0)
    assert sorted(r.key for r in other.scan().collect()) == [11, 12]
    assert sorted((r.seq, r.ts) for r in s.tracker().collect())[-1] == (4, 180)
    s.drain("2")
    assert s.scan().count() == 3 and inspect.wal_files(s).count() == 0 and inspect.manifests(s).count() >= 1


def test_trivial_move(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"), key=T.LongType(), value=T.LongType())
    for k in (1, 50):
        s.put(k, k)
        s.flush()
    s.move_down()
    assert [f["level"] for f in s.manifest().files] == [1, 1] and s.scan().count() == 2
    for _ in range(2):
        s.put(7, 7)
        s.flush()
    with pytest.raises(LogError):
        s.move_down()


def test_settings(tmp_path):
    from palimpsest.settings import Settings

    (tmp_path / "s.json").write_text('{"least_sources": 2, "size_ratio": 3.0}')
    s = Settings.load(str(tmp_path / "s.json"), environment={"PALIMPSEST_SIZE_RATIO": "5.5", "PALIMPSEST_BLOOM_FILTER": "false", "OTHER": "1"})
    assert (s.least_sources, s.size_ratio, s.bloom_filter, s.most_sources) == (2, 5.5, False, 8) and s.write_options() == {"compression": "zstd"}
    (tmp_path / "s.json").write_text('{"nothing": 2}')
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "s.json"), environment={})


def test_streaming_source(spark, tmp_path):
    from palimpsest.streaming import source

    source.register(spark)
    s = Store(spark, str(tmp_path / "a"), key=T.LongType(), value=T.LongType())
    for k in range(5):
        s.put(k, k)
    kind = T.StructType([T.StructField("batch", T.LongType()), *[T.StructField(f.name, f.dataType) for f in s.schema]])
    reader = spark.readStream.format("palimpsest_wal").schema(kind).option("path", s.root).option("after", "1")
    q = reader.load().writeStream.format("memory").queryName("wal_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert sorted((r.batch, r.key) for r in spark.sql("select * from wal_rows").collect()) == [(k + 1, k) for k in range(1, 5)]
