"""Flush and compaction: collapse of operands, retention with expiry, and the compaction filter.

What depends on the order of a key's versions is computed per span of sequence numbers and then stitched together from
one row per key and span, so that no task ever holds all versions of a key. Retention needs no order at all: the versions
that stay are those from a sequence number on that a partial aggregation finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import COLUMNS, MERGE, TOMBSTONE, VALUE
from .merge_ops import MergeOperator


#: Sequence numbers whose versions of one key are ordered in one task.
SPAN = 1 << 20


def collapse(log: DataFrame, merge: MergeOperator | None, barrier: int | None = None, span: int = SPAN) -> DataFrame:
    """Folds runs of operands (and the base below them) into one row each.

    A run ends at a row that is not an operand, at an operand beyond the snapshot barrier, and where the expiry changes.
    """
    if merge is None:
        return log.select(*COLUMNS)
    rows = log.select(*COLUMNS, F.floor(F.col("seq") / span).alias("_span"))
    newer = Window.partitionBy("key", "_span").orderBy(F.desc("seq"))
    rows = rows.withColumns({"_newer": F.lag(F.struct("kind", "seq", "expire_ts")).over(newer), "_oldest": F.lead("seq").over(newer).isNull()})
    rows = rows.withColumn("_start", _starts(F.col("_newer"), F.col("_newer")["kind"] != MERGE, barrier).cast("int"))
    rows = rows.withColumn("_run", F.sum("_start").over(newer.rowsBetween(Window.unboundedPreceding, 0)))
    # One exchange for order, runs and folds: the groups lie within key and span.
    folded = rows.groupBy("key", "_span", "_run").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("kind").alias("_only"),
        F.bool_or(F.col("kind") != MERGE).alias("_based"),
        F.max("value").alias("_value"),
        merge.agg(F.col("value"), F.col("seq"), F.col("key")).alias("_merged"),
        F.min("seq").alias("_low"),
        F.max("seq").alias("seq"),
        F.max("create_ts").alias("create_ts"),
        F.max("expire_ts").alias("expire_ts"),
        F.bool_or("_oldest").alias("_last"),
    )
    value = F.when(F.col("_n") == 1, F.col("_value")).otherwise(F.col("_merged"))
    folded = folded.withColumn("value", value).drop("_value", "_merged")
    # The first run of a span may go on the last one of the next newer span: these, two per key and span at most, are put in
    # order per key. Other runs are whole; they pass in lanes of their own span.
    edge = (F.col("_run") == 1) | F.col("_last")
    folded = folded.withColumn("_lane", F.when(edge, -1).otherwise(F.col("_span"))).drop("_span", "_last")
    lane = Window.partitionBy("key", "_lane").orderBy(F.desc("seq"))
    runs = folded.withColumn("_newer", F.lag(F.struct("_based", F.col("_low").alias("seq"), "expire_ts")).over(lane))
    start = (F.col("_run") > 1) | _starts(F.col("_newer"), F.col("_newer")["_based"], barrier)
    runs = runs.withColumn("_joined", F.sum(start.cast("int")).over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("key", "_lane", "_joined").agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_parts"),
        F.max("_only").alias("_only"),
        F.bool_or("_based").alias("_based"),
        F.max("value").alias("_value"),
        merge.agg(F.col("value"), F.col("seq"), F.col("key")).alias("_merged"),
        F.max("seq").alias("seq"),
        F.max("create_ts").alias("create_ts"),
        F.max("expire_ts").alias("expire_ts"),
    )
    kind = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_based"), VALUE).otherwise(MERGE)
    value = F.when(F.col("_parts") == 1, F.col("_value")).otherwise(F.col("_merged")).cast(folded.schema["value"].dataType)
    return out.select("key", kind.alias("kind"), value.alias("value"), "seq", "create_ts", "expire_ts")


def _starts(newer: Column, based: Column, barrier: int | None) -> Column:
    """Whether a row begins a run, by its next newer neighbour (its oldest sequence number and expiry) and whether that one is a base."""
    held = newer["seq"] > barrier if barrier is not None else F.lit(False)
    return newer.isNull() | based | held | ~newer["expire_ts"].eqNullSafe(F.col("expire_ts"))


def retain(log: DataFrame, now: int | None = None, min_seq: int | None = None, drop_tail: bool = False, timeout_ms: int | None = None, clock: int | None = None, row_time: Column | None = None, keep_tombstones: int | None = None) -> DataFrame:
    """What retention leaves of each key's versions.

    Expired operands go, expired values become tombstones. The newest version stays, and so does every version that is an
    operand, lies beyond min_seq, or lies within the time window; the first that is none of these is the last one kept.
    drop_tail removes tombstones below which nothing is left: only where the oldest run takes part, and none beyond the
    sequence number keep_tombstones, which an open transaction may still have to see.
    """
    expired = F.lit(False) if now is None else F.coalesce(F.col("expire_ts") <= now, F.lit(False))
    rows = log.where(~((F.col("kind") == MERGE) & expired))
    window = F.lit(False)
    if timeout_ms is not None:
        time = F.col("create_ts") if row_time is None else row_time
        window = F.coalesce(time, F.lit(clock)) + timeout_ms > clock
    beyond = F.col("seq") > min_seq if min_seq is not None else F.lit(False)
    stop = (F.col("kind") != MERGE) & ~beyond & ~window
    turned = (F.col("kind") == VALUE) & expired
    rows = rows.withColumns({"_stop": stop, "_turned": turned})
    rows = rows.withColumns({"kind": F.when(F.col("_turned"), TOMBSTONE).otherwise(F.col("kind")), "value": F.when(~F.col("_turned"), F.col("value")), "expire_ts": F.when(~F.col("_turned"), F.col("expire_ts"))})
    # The newest row that stops is the oldest one kept; of what is kept, tombstones older than every other row are the tail.
    found = rows.groupBy("key").agg(F.max(F.when(F.col("_stop"), F.col("seq"))).alias("_last"))
    rows = rows.join(found, "key").where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).select(*COLUMNS)
    if drop_tail:
        live = rows.where(F.col("kind") != TOMBSTONE).groupBy("key").agg(F.min("seq").alias("_live"))
        if keep_tombstones is None:
            return rows.join(live, "key").where(F.col("seq") >= F.col("_live")).select(*COLUMNS)
        rows = rows.join(live, "key", "left").where((F.col("seq") >= F.col("_live")) | (F.col("seq") > keep_tombstones)).select(*COLUMNS)
    return rows


KEEP, DROP = "keep", "drop"


def apply_filter(log: DataFrame, decide: Column, value: Column | None = None) -> DataFrame:
    """Per row: keep, drop, or change to value, merge or tombstone ('V', 'M', 'T') with a new value. A tombstone has no expiry."""
    kind = F.when(decide == KEEP, F.col("kind")).otherwise(decide)
    changed = decide != KEEP
    new = F.col("value") if value is None else F.when(changed, value).otherwise(F.col("value"))
    rows = log.withColumn("_decision", decide).where(decide != DROP)
    return rows.select("key", kind.alias("kind"), F.when(kind != TOMBSTONE, new).alias("value"), "seq", "create_ts", F.when(kind != TOMBSTONE, F.col("expire_ts")).alias("expire_ts"))


def compact(sources: list[DataFrame], merge: MergeOperator | None, now: int | None = None, barrier: int | None = None, min_seq: int | None = None, oldest: bool = False, decide: Column | None = None, value: Column | None = None, keep_tombstones: int | None = None) -> DataFrame:
    """Union, collapse, retention, filter. `oldest`: the sources include the oldest run of their segment."""
    rows = sources[0].select(*COLUMNS)
    for s in sources[1:]:
        rows = rows.unionByName(s.select(*COLUMNS))
    out = retain(collapse(rows, merge, barrier), now, min_seq, oldest, keep_tombstones=keep_tombstones)
    return out if decide is None else apply_filter(out, decide, value)


def flush(log: DataFrame, merge: MergeOperator | None, now: int | None = None, barrier: int | None = None) -> DataFrame:
    """What a memtable writes: collapse and retention, tombstones kept."""
    return retain(collapse(log, merge, barrier), now, barrier)


def collapse_batch(ops: DataFrame, merge: MergeOperator | None, seq: int, create_ts: int) -> DataFrame:
    """A write batch as log rows: the last put or delete of a key wins, operands after it are folded.

    ops: op_idx, op (put, delete, merge), key, value, expire_ts. Operands of one key with different expiry are an error.
    """
    kinds = {"put": VALUE, "delete": TOMBSTONE, "merge": MERGE}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("op")]
    rows = ops.select("op_idx", kind.alias("kind"), "key", "value", F.when(F.col("op") != "delete", F.col("expire_ts")).alias("expire_ts"))
    base = rows.where(F.col("kind") != MERGE).groupBy(F.col("key").alias("_key")).agg(F.max("op_idx").alias("_base"))
    kept = rows.join(base, rows["key"] == base["_key"], "left").where(F.col("_base").isNull() | (F.col("op_idx") >= F.col("_base")))
    fold = (merge.agg(F.col("value"), F.col("op_idx"), F.col("key")) if merge else F.max_by("value", "op_idx")).alias("_merged")
    ttl = F.collect_set(F.when(F.col("kind") == MERGE, F.coalesce(F.col("expire_ts"), F.lit(-1))))
    out = kept.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("kind") != MERGE).alias("_based"), F.max_by("kind", "op_idx").alias("_last"), F.max("value").alias("_value"), fold, F.max_by("expire_ts", "op_idx").alias("expire_ts"), ttl.alias("_ttl"))
    clash = F.when(F.size("_ttl") > 1, F.raise_error(F.lit("operands of one key with different expiry")).cast("string"))
    kind = F.when(F.col("_n") == 1, F.col("_last")).when(F.col("_based"), VALUE).otherwise(MERGE)
    out = out.select("key", F.coalesce(clash, kind).alias("kind"), F.when(F.col("_n") == 1, F.col("_value")).otherwise(F.col("_merged")).alias("value"), F.lit(seq).cast("long").alias("seq"), F.lit(create_ts).cast("long").alias("create_ts"), "expire_ts")
    return out
