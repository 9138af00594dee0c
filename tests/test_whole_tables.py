"""Queries over whole tables, at a size beyond the bounds of their bounded forms."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.plans import catalogue

from .test_queries import normal

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big():
    c = duckdb.connect()
    for t in ("events", "customer"):
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def equals_sql(spark, big, name):
    """The query's rows, once they are found equal to its SQL."""
    df = catalogue.queries()[name](spark, SF_DIR)
    rows = df.collect()
    expected = big.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal([tuple(r) for r in rows], df.columns) == normal(expected.fetchall(), expected.columns)
    return rows


def test_every_event_is_resolved(spark, big):
    assert len(equals_sql(spark, big, "ttl_resolution")) == big.sql("select count(*) from events").fetchall()[0][0]


def test_every_event_is_in_the_batch(spark, big):
    rows = equals_sql(spark, big, "batch_collapse")
    assert {r.key for r in rows} == {k for (k,) in big.sql("select distinct user_id from events").fetchall()}
    last = dict(big.sql("select user_id, arg_max(event_type, event_id) from events group by 1").fetchall())
    assert {r.key for r in rows if r.kind == "T"} == {k for k, t in last.items() if t == "error"}


@pytest.mark.parametrize("name", ["merge_sum", "merge_concat", "merge_metadata", "merge_append_after_compaction"])
def test_every_operand_is_folded(spark, big, name):
    rows = equals_sql(spark, big, name)
    newest = dict(big.sql("select user_id, max(event_id) + 1 from events group by 1 having arg_max(event_type, event_id) <> 'error'").fetchall())
    assert {r.key: r.seq for r in rows} == newest and max(newest.values()) > catalogue.SEQ and max(newest) >= 100


def test_bank_total_at_the_last_sequence_number(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("event_id", F.col("event_id") + 2_345)
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = {r.bound: r for r in catalogue.queries()["bank_total_invariant"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    expected = con.sql(catalogue.oracle_sql()["bank_total_invariant"])
    got = [tuple(r[c] for c in expected.columns) for r in rows.values() if r.accounts]
    assert 12_345 in rows and normal(got, expected.columns) == normal(expected.fetchall(), expected.columns)
    assert {r.total for r in rows.values() if r.accounts} == {0}


@pytest.mark.parametrize("name", ["txn_ww_conflicts", "txn_rw_conflicts", "txn_phantom_conflicts"])
def test_every_write_and_read_meets(spark, big, name):
    assert equals_sql(spark, big, name)


def test_committable_sees_every_write(spark, big, tmp_path):
    equals_sql(spark, big, "txn_committable")
    odd = F.col("id").isin(40, 84)  # sequence numbers 41 and 85, in transactions 1 and 2
    events = spark.range(160).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.when(odd, 7).otherwise(F.col("id") + 100).alias("user_id"), F.when(odd, "error").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert {r.txn_id for r in catalogue.queries()["txn_committable"](spark, str(tmp_path)).collect()} == {0, 3, 4}


def test_overlap_depth_counts_every_key(spark, big):
    files = big.sql("select min(user_id), max(user_id) from events group by (event_id + 1) // 50").fetchall()
    deepest = max(sum(lo <= at <= hi for lo, hi in files) for at, _ in files)
    assert [r.depth for r in equals_sql(spark, big, "l0_overlap_depth")] == [deepest]


def test_tracker_at_the_default_interval(spark, big):
    rows = equals_sql(spark, big, "tracker_sampling")
    assert len(rows) > 720 and min(b.ts - a.ts for a, b in zip(rows, rows[1:])) >= 60


def test_tracker_beyond_its_capacity(spark, tmp_path):
    events = spark.range(17_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 61).alias("ts"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = catalogue.queries()["tracker_sampling"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = con.sql(catalogue.oracle_sql()["tracker_sampling"]).fetchall()
    assert 4_096 < len(rows) <= 8_192 and sorted((r.seq, r.ts) for r in rows) == sorted(found)
