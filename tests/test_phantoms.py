"""Phantom conflicts against a comparison of every range with every write."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import txn

TXNS = "txn_id long, isolation string, started_seq long, committed_seq long"
FLAGS = "lo_open boolean, hi_open boolean"


def brute(txns, ranges, writes):
    by = {t[0]: t for t in txns}
    out = set()
    for me, lo, hi, lo_open, hi_open in ranges:
        _, isolation, started, _ = by[me]
        for other, key in writes:
            done = by[other][3]
            if isolation != "SSI" or other == me or done is None or done <= started or key is None:
                continue
            if (lo is None or key > lo or (key == lo and not lo_open)) and (hi is None or key < hi or (key == hi and not hi_open)):
                out.add((me, lo, hi))
    return out


def draw(rng, key):
    txns = [(i, rng.choice(["SI", "SSI", "SSI"]), s := rng.randrange(60), rng.choice([None, s + rng.randrange(1, 40)])) for i in range(14)]
    ranges = [(rng.randrange(14), rng.choice([None, key(), key()]), rng.choice([None, key(), key()]), rng.random() < 0.5, rng.random() < 0.5) for _ in range(120)]
    writes = [(rng.randrange(14), key()) for _ in range(rng.choice([1, 12, 40]))]
    return txns, ranges, writes


KEYS = {
    "long": lambda rng: lambda: rng.randrange(-40, 40) * 37,
    "dense": lambda rng: lambda: rng.randrange(9),
    "wide": lambda rng: lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 0, rng.randrange(-(1 << 62), 1 << 62)]),
    "almost": lambda rng: lambda: rng.choice([0, (1 << 62) - 1, rng.randrange(1 << 62)]),
    "binary": lambda rng: lambda: bytes(rng.randrange(4) for _ in range(rng.randrange(1, 4))),
    "string": lambda rng: lambda: rng.choice(["", "a", "b", "ba", "é", "z"]),
}


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("seed", range(2))
def test_phantoms_equal_brute_force(spark, kind, seed):
    rng = random.Random(seed)
    txns, ranges, writes = draw(rng, KEYS[kind](rng))
    sql = kind if kind in ("binary", "string") else "long"
    null = [] if sql == "long" else [(3, None)]
    got = txn.phantom_conflicts(
        spark.createDataFrame(txns, TXNS),
        spark.createDataFrame(ranges, f"txn_id long, lo {sql}, hi {sql}, {FLAGS}").withColumns({"node": F.lit(1), "_lo": F.lit(2)}),
        spark.createDataFrame(writes + null, f"txn_id long, key {sql}"),
    ).collect()
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    found = [(r.txn_id, plain(r.lo), plain(r.hi)) for r in got]
    assert set(found) == brute(txns, ranges, writes) and len(found) == len(set(found))


def test_no_writes_and_no_nested_loops(spark):
    txns = spark.createDataFrame([(1, "SSI", 0, 9), (2, "SI", 0, 9)], TXNS)
    ranges = spark.createDataFrame([(1, None, None, False, False)], f"txn_id long, lo long, hi long, {FLAGS}")
    writes = spark.createDataFrame([(2, 5)], "txn_id long, key long")
    assert txn.phantom_conflicts(txns, ranges, writes.limit(0)).count() == 0
    met = txn.phantom_conflicts(txns, ranges, writes)
    assert met.count() == 1
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
