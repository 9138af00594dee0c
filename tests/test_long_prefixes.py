"""Segment prefixes of any length."""

from __future__ import annotations

from palimpsest.operators import segments as G


def test_violations_beyond_sixty_four_characters(spark):
    a, b = "a" * 65, "b" * 3000
    p = spark.createDataFrame([(x,) for x in (a, a + "x", b, b + "y" * 2000, "c", None)], "prefix string")
    assert sorted(tuple(r) for r in G.antichain_violations(p).collect()) == [(a, a + "x"), (b, b + "y" * 2000)]


def test_the_empty_prefix_holds_all(spark):
    p = spark.createDataFrame([("",), ("a",)], "prefix string")
    assert [tuple(r) for r in G.antichain_violations(p).collect()] == [("", "a")]
    assert G.antichain_violations(p.limit(0)).count() == 0
