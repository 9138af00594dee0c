"""Z-order keys against bits put in turn by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codecs


def by_hand(parts, bits):
    text = "".join("".join(f"{p:0{bits}b}"[i] for p in parts) for i in range(bits))
    return int(text, 2).to_bytes(8, "big")


@pytest.mark.parametrize(("n", "bits"), [(2, 31), (3, 21), (1, 63), (2, 3)])
def test_morton(spark, n, bits):
    rng = random.Random(n)
    rows = [tuple(rng.choice([0, (1 << bits) - 1, rng.randrange(1 << bits)]) for _ in range(n)) for _ in range(60)] + [(None,) * n]
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names)).withColumn("k", codecs.morton(*map(F.col, names), bits=bits))
    got = df.select("*", *[codecs.morton_decode(F.col("k"), i, n, bits).alias(f"y{i}") for i in range(n)]).collect()
    assert len(got) == len(rows)
    for r in got:
        parts = tuple(r[x] for x in names)
        assert tuple(r[f"y{i}"] for i in range(n)) == parts
        assert r.k is None if None in parts else bytes(r.k) == by_hand(parts, bits)


def test_cells(spark):
    df = spark.createDataFrame([(x,) for x in (-200.0, -180.0, -90.0, 0.0, 179.999, 180.0, 500.0, None)], "x double")
    assert [r.c for r in df.select(codecs.cell(F.col("x"), -180, 180, 2).alias("c")).collect()] == [0, 0, 1, 2, 3, 3, 3, None]


def test_too_many_bits():
    with pytest.raises(ValueError):
        codecs.morton(F.lit(1), F.lit(2), bits=32)
