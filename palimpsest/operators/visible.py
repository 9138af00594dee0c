"""Reads: the state of a log that is visible at a sequence number.

Rows beyond the bound are dropped before anything else. A key's base is its newest value or tombstone; older rows don't
count, and operands above the base are folded over it. The base is found by an aggregation with a partial step and joined
back, so that a key with a third of all rows needs no task of its own: adaptive execution splits the join and the fold
is partial again. Expiry never hides a row here.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import KeyRange
from .log import MERGE, TOMBSTONE, UNCOMMITTED, LogError, order_of
from .merge_ops import MergeOperator

OUTPUT = ("key", "value", "seq", "create_ts", "expire_ts")


def read_bound(committed: int, persisted: int | None = None, *, snapshot: int | None = None, dirty: bool = False, remote: bool = False) -> int | None:
    """The sequence number up to which a read sees rows: the least bound that applies; None for none."""
    bounds = [] if dirty else [committed]
    if remote:
        bounds.append(committed if persisted is None else persisted)
    if snapshot is not None:
        bounds.append(snapshot)
    return min(bounds) if bounds else None


def bounded(log: DataFrame, seq: int | None = None, keys: KeyRange | None = None, where: Column | None = None) -> DataFrame:
    out = log
    if seq is not None:
        out = out.where(F.col("seq") <= seq)
    if keys is not None:
        out = out.where(keys.predicate("key"))
    return out if where is None else out.where(where)


def visible(log: DataFrame, merge: MergeOperator | None = None, seq: int | None = None, keys: KeyRange | None = None, where: Column | None = None) -> DataFrame:
    """key, value, seq, create_ts, expire_ts of every live key, in no order.

    Without an operator the newest row of each key counts, in a single partial aggregation; meeting an operand is an error.
    With one: newest sequence number and creation time, earliest expiry of the rows that were folded.
    """
    v = bounded(log, seq, keys, where)
    order = order_of(v)
    if merge is None:
        newest = v.groupBy("key").agg(F.max_by(F.struct("kind", "value", "seq", "create_ts", "expire_ts"), order).alias("n"))
        checked = F.when(F.col("n.kind") == MERGE, F.raise_error(F.lit("merge operand without a merge operator")).cast(v.schema["value"].dataType)).otherwise(F.col("n.value"))
        return newest.where(F.col("n.kind") != TOMBSTONE).select("key", checked.alias("value"), "n.seq", "n.create_ts", "n.expire_ts")
    v = v.withColumn("_order", order)
    base = v.where(F.col("kind") != MERGE).groupBy(F.col("key").alias("_key")).agg(F.max("_order").alias("_base"))
    counted = v.join(base, v["key"] == base["_key"], "left").where(F.col("_base").isNull() | (F.col("_order") >= F.col("_base")))
    folded = counted.groupBy("key").agg(
        merge.agg(F.col("value"), F.col("_order"), F.col("key")).alias("value"),
        F.max("seq").alias("seq"),
        F.max("create_ts").alias("create_ts"),
        F.min("expire_ts").alias("expire_ts"),
        F.max_by("kind", "_order").alias("_last"),
    )
    return folded.where(F.col("_last") != TOMBSTONE).select(*OUTPUT)


def get(log: DataFrame, key: Any, merge: MergeOperator | None = None, seq: int | None = None) -> DataFrame:
    """The row of one key, or none."""
    return visible(log, merge, seq, KeyRange.point(key))


def multi_get(log: DataFrame, wanted: DataFrame, merge: MergeOperator | None = None, seq: int | None = None) -> DataFrame:
    """The rows of many keys (column key). A small table is broadcast by Spark, a large one shuffles."""
    return visible(bounded(log, seq).join(wanted.select("key").distinct(), "key", "left_semi"), merge)


def scan(log: DataFrame, keys: KeyRange | None = None, merge: MergeOperator | None = None, seq: int | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Visible rows of a range in key order."""
    out = visible(log, merge, seq, keys).orderBy(F.desc("key") if descending else F.asc("key"))
    return out if limit is None else out.limit(limit)


def scan_prefix(log: DataFrame, prefix: bytes, inner: KeyRange | None = None, **options: Any) -> DataFrame:
    return scan(log, KeyRange.prefix(prefix, inner), **options)


class Cursor:
    """A scan that can skip forward: each seek narrows the range of the same snapshot."""

    def __init__(self, log: DataFrame, keys: KeyRange | None = None, merge: MergeOperator | None = None, seq: int | None = None) -> None:
        self.log, self.keys, self.merge, self.seq, self.last = log, keys or KeyRange(), merge, seq, None

    def seek(self, key: Any) -> DataFrame:
        from ..functions.ranges import included

        if not self.keys.contains(key):
            raise LogError("seek beyond the range of the scan")
        if self.last is not None and key <= self.last:
            raise LogError("seek must move forward")
        self.last = key
        rest = self.keys.intersect(KeyRange(included(key)))
        if rest is None:
            raise LogError("seek beyond the range of the scan")
        return scan(self.log, rest, self.merge, self.seq)


def overlay(log: DataFrame, batch: DataFrame, snapshot: int, merge: MergeOperator | None = None, keys: KeyRange | None = None) -> DataFrame:
    """What a transaction reads: its snapshot under its own uncommitted operations (with op_idx, later ones win)."""
    committed = log.where(F.col("seq") <= snapshot).withColumn("op_idx", F.lit(-1))
    own = batch.withColumn("seq", F.lit(UNCOMMITTED))
    return visible(committed.select(*own.columns).unionByName(own), merge, keys=keys)


def scan_by_recency(log: DataFrame, prefix: KeyRange, seq: int | None = None, source: str = "source_rank", segment: str | None = None) -> DataFrame:
    """Raw versions with tombstones and operands, newest source first, then by key and newest version. One segment only."""
    v = bounded(log, seq, prefix)
    if segment is not None and v.select(segment).distinct().limit(2).count() > 1:
        raise LogError("a scan by recency must lie within one segment")
    return v.orderBy(source, "key", F.desc("seq"))
