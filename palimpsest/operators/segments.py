"""Segments, key-range algebra over sources, and overlap depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import KeyRange
from .log import LogError


def listing(log: DataFrame, segment: str = "segment") -> DataFrame:
    return log.groupBy(segment).agg(F.count(F.lit(1)).alias("versions"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("last_seq"))


def antichain_violations(prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """outer, inner: segment prefixes of which one is a proper prefix of the other.

    Each prefix is cut to the shorter lengths that occur, and the cuts meet the others in an equi-join.
    """
    p = prefixes.select(F.col(column).alias("inner")).distinct()
    lengths = sorted(r[0] for r in p.where("inner is not null").select(F.char_length("inner")).distinct().collect())  # at most the longest prefix in rows
    shorter = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n < F.char_length("inner"))
    cut = p.withColumn("outer", F.explode(F.transform(shorter, lambda n: F.substring("inner", F.lit(1), n))))
    return cut.join(p.select(F.col("inner").alias("outer")), "outer", "left_semi").select("outer", "inner")


def project(log: DataFrame, keys: KeyRange, segments: list | None = None, segment: str = "segment") -> DataFrame:
    """A source clipped to a key range, and to some of its segments."""
    out = log.where(keys.predicate("key"))
    return out if segments is None else out.where(F.col(segment).isin(segments))


def overlaps(bounds: DataFrame) -> DataFrame:
    """left, right: sources whose closed key bounds (name, lo, hi) meet.

    In order of lo, a source meets an earlier one exactly if its lo does not lie beyond the greatest hi so far; each is
    reported with the earlier source that reaches furthest, which is enough to refuse a union.
    """
    w = Window.orderBy("lo", "name").rowsBetween(Window.unboundedPreceding, -1)
    far = bounds.withColumn("_far", F.max(F.struct("hi", "name")).over(w))  # one row per source
    return far.where(F.col("_far.hi") >= F.col("lo")).select(F.col("_far.name").alias("left"), F.col("name").alias("right"))


def union_disjoint(sources: list[DataFrame]) -> DataFrame:
    """All rows of sources whose key ranges are disjoint; else an error."""
    bounds = None
    for i, s in enumerate(sources):
        b = s.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select(F.lit(i).alias("name"), "lo", "hi").where("lo is not null")
        bounds = b if bounds is None else bounds.unionByName(b)
    if bounds is None or not overlaps(bounds).isEmpty():
        raise LogError("sources of a union must have disjoint key ranges")
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def overlap_depth(files: DataFrame) -> DataFrame:
    """depth: the greatest number of files (lo, hi closed) that hold one key, by a sweep over their ends."""
    ends = files.select(F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("turn"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    steps = ends.groupBy("at", "turn").agg(F.sum("step").alias("step"))
    w = Window.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)  # two rows per distinct file bound
    return steps.select(F.sum("step").over(w).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("depth"))
