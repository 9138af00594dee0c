"""Optimistic transactions: conflict detection as semi-joins over tables of keys.

txns: txn_id, isolation ('SI' or 'SSI'), started_seq, committed_seq (null while open); writes, reads, unmarked: txn_id,
key; ranges: txn_id, lo, hi (null for none), lo_open, hi_open — the ranges asked for, whether or not they held a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..settings import scratch


def tracked_writes(writes: DataFrame, unmarked: DataFrame | None = None) -> DataFrame:
    return writes if unmarked is None else writes.join(unmarked, ["txn_id", "key"], "left_anti")


def _others(txns: DataFrame, writes: DataFrame) -> DataFrame:
    """Keys written by committed transactions."""
    done = txns.where("committed_seq is not null").select("txn_id", "committed_seq")
    return writes.join(done, "txn_id").select(F.col("txn_id").alias("other"), F.col("key").alias("other_key"), "committed_seq")


def _met(mine: DataFrame, txns: DataFrame, others: DataFrame) -> DataFrame:
    own = mine.join(txns.select("txn_id", "started_seq"), "txn_id")
    return own.join(others, (own["key"] == others["other_key"]) & (others["committed_seq"] > own["started_seq"]) & (others["other"] != own["txn_id"]), "left_semi")


def write_conflicts(txns: DataFrame, writes: DataFrame, unmarked: DataFrame | None = None) -> DataFrame:
    """txn_id, key: my written keys that another transaction committed after my start."""
    tracked = tracked_writes(writes, unmarked)
    return _met(tracked, txns, _others(txns, tracked)).select("txn_id", "key").distinct()


def read_conflicts(txns: DataFrame, reads: DataFrame, writes: DataFrame, marked: DataFrame | None = None, unmarked: DataFrame | None = None) -> DataFrame:
    """txn_id, key: keys that I read (SSI) or marked as read (any isolation) and another transaction wrote."""
    strict = reads.join(txns.where("isolation = 'SSI'").select("txn_id"), "txn_id", "left_semi").select("txn_id", "key")
    mine = strict if marked is None else strict.unionByName(marked.select("txn_id", "key"))
    return _met(mine, txns, _others(txns, tracked_writes(writes, unmarked))).select("txn_id", "key").distinct()


#: A tree of nodes halves whole numbers below 2 to this power; wider keys are numbered first.
WIDEST = 62


def _numbered(keys: DataFrame) -> DataFrame:
    """key, at: whole numbers in the order of the keys. Written out, because they are read more than once and must be the same."""
    spark = keys.sparkSession
    path = scratch(spark)
    ordered = keys.where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
    ordered.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def phantom_conflicts(txns: DataFrame, ranges: DataFrame, writes: DataFrame, unmarked: DataFrame | None = None) -> DataFrame:
    """txn_id, lo, hi: scanned ranges into which another transaction wrote after the start of the one that scanned.

    A range is cut into at most six nodes a level of a tree over the keys, a written key lies in one node a level, and both meet
    on the node: no pairs of ranges and writes are formed, however wide or open a range is. Of a node only the last committer
    and the last one other than that are kept, which decide for every range. Whole-number keys are their own places in the
    tree; others are numbered in order. A null key lies in no range; a null flag of an end is an open end.
    """
    own = ranges.join(txns.where("isolation = 'SSI'").select("txn_id", "started_seq"), "txn_id").select("txn_id", "lo", "hi", "lo_open", "hi_open", "started_seq").distinct()
    others = _others(txns, tracked_writes(writes, unmarked)).where("other_key is not null")
    least, most = others.agg(F.min("other_key"), F.max("other_key")).first()
    columns = ["txn_id", "lo", "hi"]
    if least is None:
        return own.select(*columns).limit(0)
    lo, hi = F.col("lo"), F.col("hi")
    whole = isinstance(others.schema["other_key"].dataType, IntegralType) and all(isinstance(own.schema[c].dataType, (IntegralType, NullType)) for c in ("lo", "hi"))
    if whole and most - least < 1 << WIDEST:
        first, last, least = lo.cast("long"), hi.cast("long"), int(least)
        places = others.withColumn("at", F.col("other_key").cast("long"))
    else:
        ends = own.select(lo.alias("key")).unionByName(own.select(hi.alias("key")))
        at = _numbered(others.select(F.col("other_key").alias("key")).unionByName(ends))
        places = others.join(at.withColumnRenamed("key", "other_key"), "other_key")
        own = own.join(at.select(F.col("key").alias("lo"), F.col("at").alias("_lo")), "lo", "left").join(at.select(F.col("key").alias("hi"), F.col("at").alias("_hi")), "hi", "left")
        first, last = F.col("_lo"), F.col("_hi")
        least, most = places.agg(F.min("at"), F.max("at")).first()
    levels = max(1, ((int(most) - least).bit_length() + 1) // 2)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")

    def up(n: Column, by: Column) -> Column:
        return F.call_function("shiftright", n, by)

    def size(of: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), of)

    bits = 2 * F.col("level")
    # the last committer of a node, then the last one that is not the same transaction
    held = places.select((F.col("at") - F.lit(least)).alias("at"), "other", "committed_seq", level)
    held = held.groupBy("level", up(F.col("at"), bits).alias("node"), "other").agg(F.max("committed_seq").alias("committed_seq"))
    newest = held.groupBy("level", "node").agg(F.max_by("other", F.struct("committed_seq", "other")).alias("top"), F.max("committed_seq").alias("top_seq"))
    tops = held.join(newest, ["level", "node"]).groupBy("level", "node", "top", "top_seq").agg(F.max(F.when(F.col("other") != F.col("top"), F.col("committed_seq"))).alias("next_seq"))

    # places from `begin` to before `end`, within those that hold a write
    start = F.when(lo.isNull() | (first < least), F.lit(0)).when(first <= most, first - F.lit(least) + F.coalesce(F.col("lo_open"), F.lit(True)).cast("long"))
    stop = F.when(hi.isNull() | (last > most), F.lit(int(most) - least + 1)).when(last >= least, last - F.lit(least) + 1 - F.coalesce(F.col("hi_open"), F.lit(True)).cast("long"))
    cut = own.select(*columns, "started_seq", start.cast("long").alias("begin"), stop.cast("long").alias("end")).where("begin < end").select("*", level)

    def ceiling(n: Column, by: Column) -> Column:
        return up(n + size(by) - 1, by)

    f, e = ceiling(F.col("begin"), bits), up(F.col("end"), bits)
    nf, ne = ceiling(F.col("begin"), bits + 2), up(F.col("end"), bits + 2)
    none = F.array().cast("array<bigint>")

    def nodes(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    topmost = (F.col("level") == levels - 1) | (nf >= ne)
    parts = cut.select(*columns, "started_seq", "level", F.explode(F.when(topmost, nodes(f, e)).otherwise(F.concat(nodes(f, 4 * nf), nodes(4 * ne, e)))).alias("node"))
    met = parts.join(tops, ["level", "node"]).where((F.col("top_seq") > F.col("started_seq")) & ((F.col("top") != F.col("txn_id")) | (F.col("next_seq") > F.col("started_seq"))))
    return met.select(*columns).distinct()


def committable(txns: DataFrame, *conflicts: DataFrame) -> DataFrame:
    """Transactions without a conflict."""
    out = txns
    for c in conflicts:
        out = out.join(c.select("txn_id").distinct(), "txn_id", "left_anti")
    return out
