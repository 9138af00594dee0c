"""Segments that share the files of a flush."""

from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.ranges import KeyRange, excluded, included
from palimpsest.operators import merge_ops as M
from palimpsest.plans.size_tiered import Proposal
from palimpsest.sources import inspect
from palimpsest.sources.store import Manifest, Store

from .test_semantics import random_rows


def store(spark, path, width=10, **options):
    return Store(spark, str(path), segment=lambda k: F.floor(k / width), key=T.LongType(), value=T.LongType(), **options)


def put(s, values, now_ms=0):
    s.write(s._ops([("put", k, v, None) for k, v in values.items()]), now_ms=now_ms)
    s.flush()


def state(df):
    return {r.key: r.value for r in df.collect()}


def parts(s):
    return sorted(str(p) for p in Path(s.root, "data").rglob("part-*"))


def test_files_follow_the_data_and_not_the_segments(spark, tmp_path):
    s = store(spark, tmp_path / "a", width=1)
    put(s, {k: -k for k in range(300)})
    m = s.manifest()
    assert len({f["segment"] for f in m.files}) == len(m.files) == 300 and inspect.segments(s).count() == 300
    assert 1 <= len(parts(s)) <= 4  # one per partition at most; one per segment before
    assert sum(f["size"] for f in m.files) <= s.files.size(m.files[0]["path"]) + 300
    assert state(s.scan()) == {k: -k for k in range(300)} and state(s.get(123)) == {123: -123} and s.get(999).count() == 0
    assert state(s.scan(KeyRange(included(7), excluded(9)))) == {7: -7, 8: -8}


def test_a_point_reads_only_the_parts_of_its_segment(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay apart
    try:
        s = store(spark, tmp_path / "a")
        put(s, {k: k for k in range(200)})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts(s)) > 1
    for key in (0, 57, 199):
        (f,) = s.pruned(s.manifest(), KeyRange.point(key)).files
        assert len(s.log(s.pruned(s.manifest(), KeyRange.point(key))).inputFiles()) == len(f["parts"]) < len(parts(s))
        assert state(s.get(key)) == {key: key}


def test_segments_leave_shared_files_one_by_one(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    for i in range(3):
        put(s, {k: 100 * i + k for k in range(i, 50, 3 - i)}, 60_000 * i)
    expected = {k: 100 * i + k for i in range(3) for k in range(i, 50, 3 - i)}
    assert state(s.scan()) == expected
    for n, segment in enumerate(("1", "3")):
        tree = next(t for t in s.trees() if t.segment == segment)
        s.compact(Proposal(segment, tuple(f.id for f in tree.files), n + 1))
        assert state(s.scan()) == expected and len([f for f in s.manifest().files if f["segment"] == segment]) == 1
        assert s.log().groupBy("key", "seq").count().where("count > 1").isEmpty()  # what was compacted is not read from the shared files too
    assert s.scan_by_recency(KeyRange()).count() == s.log().count() and [r.key for r in s.scan_by_recency(KeyRange()).take(3)] == [2, 3, 4]
    other = s.clone(str(tmp_path / "b"), segments=["0", "1"])
    mixed = s.clone(str(tmp_path / "c"), clip="key < 45", segments=["3", "4"])
    joined = Store.union(str(tmp_path / "d"), [other, mixed])
    s.drain("2")
    s.drain("4")
    assert state(s.scan()) == {k: v for k, v in expected.items() if k // 10 not in (2, 4)}
    s.collect_garbage(0)
    assert state(s.scan()) == {k: v for k, v in expected.items() if k // 10 not in (2, 4)}
    assert state(other.scan()) == {k: v for k, v in expected.items() if k // 10 in (0, 1)}
    assert state(joined.scan()) == {k: v for k, v in expected.items() if k < 45 and k // 10 != 2}


def test_parts_without_listed_segments_are_collected(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = store(spark, tmp_path / "a")
        put(s, {k: k for k in range(200)})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    before = parts(s)
    kept = next(f for f in s.manifest().files if f["segment"] == "7")
    for segment in [f["segment"] for f in s.manifest().files if f["segment"] != "7"]:
        s.drain(segment)
    assert s.collect_garbage(86_400_000) == [] and parts(s) == before  # too young
    s.collect_garbage(0)
    assert [p.rsplit("/", 1)[1] for p in parts(s)] == kept["parts"] and len(before) > len(kept["parts"])
    assert state(s.scan()) == {k: k for k in range(70, 80)}


def test_names_of_segments(spark, tmp_path):
    """A segment's name is no folder's name: slashes, blanks, bytes that are no UTF-8, and keys without one."""
    s = Store(spark, str(tmp_path / "a"), segment=lambda k: F.when(F.octet_length(k) > 1, F.substring(k, 1, 2)), key=T.BinaryType(), value=T.LongType())
    keys = [b"a/1", b"a/2", b"a:x", b"%2f", b"  ", b"q", b"\xff\xfe1", b"\xff\xfd2", b"=", b"a\x00b"]
    for i in range(2):
        put(s, {k: i for k in keys}, i)
    assert {bytes(r.key): r.value for r in s.scan().collect()} == dict.fromkeys(keys, 1)
    for k in keys:
        assert [(bytes(r.key), r.value) for r in s.get(k).collect()] == [(k, 1)]
    assert None in {t.segment for t in s.trees()} and inspect.segments(s).count() == len(s.trees())
    for n in range(len(s.trees())):
        s.compact()
    assert all(f["level"] for f in s.manifest().files) and {bytes(r.key): r.value for r in s.scan().collect()} == dict.fromkeys(keys, 1)


def test_folders_of_single_segments_are_still_read(spark, tmp_path):
    """A manifest of before, whose segments have a folder each."""
    s = store(spark, tmp_path / "a")
    put(s, {1: 1, 11: 2, 12: 3})
    m = s.manifest()
    for segment in ("0", "1"):
        s.log().where(F.floor(F.col("key") / 10).cast("string") == segment).write.parquet(f"{s.root}/data/old/segment={segment}")
    m.files = [{"path": f"{s.root}/data/old/segment={x}", "level": 0, "run": None, "size": 1, "segment": x} for x in ("0", "1")]
    s._commit(Manifest(**json.loads(m.text())))
    put(s, {11: 9, 21: 4})
    assert state(s.scan()) == {1: 1, 11: 9, 12: 3, 21: 4} and state(s.get(12)) == {12: 3}
    s.collect_garbage(0)
    s.compact(Proposal("1", tuple(f.id for f in next(t for t in s.trees() if t.segment == "1").files), 1))
    assert state(s.scan()) == {1: 1, 11: 9, 12: 3, 21: 4}


def test_random_logs_in_segments(spark, tmp_path):
    """A store with segments and one without hold the same state after the same flushes and compactions."""
    rows = random_rows(random.Random(1), 400, 40)
    seqs = sorted({r[3] for r in rows})
    plain = Store(spark, str(tmp_path / "p"), M.SUM, key=T.LongType(), value=T.LongType())
    cut = store(spark, tmp_path / "s", width=3, merge=M.SUM)
    for lo in range(0, len(seqs), 120):
        batch = [r for r in rows if r[3] in set(seqs[lo : lo + 120])]
        for s in (plain, cut):
            s.load(spark.createDataFrame(batch, s.schema))
            s.flush(0)
    cut.compact(None, 0)
    assert sorted(map(tuple, plain.scan().collect())) == sorted(map(tuple, cut.scan().collect()))
