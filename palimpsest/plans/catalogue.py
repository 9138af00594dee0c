"""The named queries over the driver's tables and their equivalents in SQL.

`events` is read as a log: user as key, event_id + 1 as sequence number, errors as tombstones, purchases as merge operands,
everything else as values in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, ttl
from ..functions.ranges import KeyRange, excluded, included
from ..operators import compact as C
from ..operators import merge_ops as M
from ..operators import segments as G
from ..operators import seqtime as Q
from ..operators import txn as X
from ..operators import visible as V
from ..operators.log import COLUMNS, MERGE, TOMBSTONE, VALUE, as_log
from ..settings import scratch
from ..sources import inspect
from ..sources.store import Conflict, Fenced, Store
from ..streaming import cdc

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Parameters of the catalogue.
#: A snapshot, a barrier and a retention bound are bounds by their nature; everything else reads whole tables.
SEQ, BARRIER, MIN_SEQ = 9000, 5000, 7000
NOW = 1_704_931_200_000  # ms
DAY = 86_400_000


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _WITH + sql if not sql.lstrip().upper().startswith("WITH ") else sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- logs


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", TOMBSTONE).when(F.col("event_type") == "purchase", MERGE).otherwise(VALUE)
    created = F.unix_millis(F.col("ts").cast("timestamp"))
    expires = F.when(F.col("event_id") % 3 == 0, created + DAY * (1 + F.col("event_id") % 7))
    return as_log(e, F.col("user_id"), kind, F.round(F.col("value") * 100).cast("long"), F.col("event_id") + 1, created, expires, segment=F.floor(F.col("user_id") / 10), event_type=F.col("event_type"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    created = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return as_log(o, F.col("o_custkey"), F.lit(VALUE), F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderkey") + 1, created)


def ranked(log: DataFrame) -> DataFrame:
    """With source_rank: a thousand sequence numbers per source, 0 for the newest."""
    last = log.agg(F.max("seq").alias("_last"))  # one row
    return log.crossJoin(F.broadcast(last)).withColumn("source_rank", F.floor((F.col("_last") - F.col("seq")) / 1000)).drop("_last")


_WITH = """WITH RECURSIVE log AS (
  SELECT user_id AS key, CASE event_type WHEN 'error' THEN 'T' WHEN 'purchase' THEN 'M' ELSE 'V' END AS kind,
         CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS value, event_id + 1 AS seq, epoch_us(ts) // 1000 AS create_ts,
         CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN epoch_us(ts) // 1000 + 86400000 * (1 + event_id % 7) END AS expire_ts,
         user_id // 10 AS segment, event_type, ((SELECT max(event_id) FROM events) - event_id) // 1000 AS source_rank FROM events)
"""


def f1(agg: str = "CAST(sum(value) AS BIGINT)", where: str = "TRUE", source: str = "log", more: str = "") -> str:
    """Visible state in SQL: the bound first, then the base, then the fold."""
    return f""", v AS (SELECT * FROM {source} WHERE {where}),
b AS (SELECT *, max(CASE WHEN kind <> 'M' THEN seq END) OVER (PARTITION BY key) AS base FROM v),
state AS (SELECT key, {agg} AS value, max(seq) AS seq, max(create_ts) AS create_ts, min(expire_ts) AS expire_ts
          FROM b WHERE base IS NULL OR seq >= base GROUP BY key HAVING arg_max(kind, seq) <> 'T') {more}
"""


STATE = "SELECT key, value, seq, create_ts, expire_ts FROM state"

# -- reads


@_query(f1() + STATE)
def scan_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(event_log(spark, sf_dir), M.SUM)


@_query(f1(where="key = 7") + STATE)
def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.get(event_log(spark, sf_dir), 7, M.SUM)


@_query(f1(where="key IN (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 3 = 0)") + STATE)
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    return V.multi_get(event_log(spark, sf_dir), wanted, M.SUM)


@_query(f1(where="key >= 20 AND key < 90") + STATE)
def scan_range_incl_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scan(event_log(spark, sf_dir), KeyRange(included(20), excluded(90)), M.SUM)


@_query(f1(where="key > 20 AND key <= 90") + STATE)
def scan_range_excl_incl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scan(event_log(spark, sf_dir), KeyRange(excluded(20), included(90)), M.SUM)


@_query(", state AS (SELECT o_custkey AS key, CAST(round(arg_max(o_totalprice, o_orderkey) * 100) AS BIGINT) AS value, max(o_orderkey) + 1 AS seq, arg_max(epoch_us(o_orderdate) // 1000, o_orderkey) AS create_ts, CAST(NULL AS BIGINT) AS expire_ts FROM orders GROUP BY o_custkey) " + STATE)
def scan_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(order_log(spark, sf_dir))


def _binary(log: DataFrame) -> DataFrame:
    return log.withColumn("key", F.concat(codecs.text(F.concat(F.lit("u"), F.pmod("key", F.lit(7)).cast("string"), F.lit("/"))), codecs.u64(F.col("key"))))


def _hexed(df: DataFrame) -> DataFrame:
    return df.select(F.hex("key").alias("key_hex"), "value", "seq")


_HEX = "hex(encode('u' || (key % 7) || '/')) || lpad(upper(to_hex(key)), 16, '0')"
_BINARY_SQL = f", hexed AS (SELECT * REPLACE ({_HEX} AS key) FROM log)"


@_query(_BINARY_SQL + f1(where="key >= hex(encode('u3/')) AND key < hex(encode('u30'))", source="hexed") + "SELECT key AS key_hex, value, seq FROM state")
def scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(V.scan_prefix(_binary(event_log(spark, sf_dir)), b"u3/", merge=M.SUM))


@_query(_BINARY_SQL + f1(where="key >= hex(encode('u3/')) || lpad(upper(to_hex(40)), 16, '0') AND key < hex(encode('u3/')) || lpad(upper(to_hex(100)), 16, '0')", source="hexed") + "SELECT key AS key_hex, value, seq FROM state")
def scan_prefix_subrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = KeyRange(included((40).to_bytes(8, "big")), excluded((100).to_bytes(8, "big")))
    return _hexed(V.scan_prefix(_binary(event_log(spark, sf_dir)), b"u3/", inner, merge=M.SUM))


@_query(f1() + STATE + " ORDER BY key DESC LIMIT 25")
def scan_desc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scan(event_log(spark, sf_dir), None, M.SUM, descending=True, limit=25)


@_query(f1(where="key >= 40 AND key < 120") + STATE)
def seek_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.Cursor(event_log(spark, sf_dir), KeyRange(included(10), excluded(120)), M.SUM).seek(40)


@_query(f1(where=f"seq <= {SEQ}") + STATE)
def snapshot_read_at_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(event_log(spark, sf_dir), M.SUM, SEQ)


@_query(f1(where="seq <= 6500") + STATE)
def durability_min_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(event_log(spark, sf_dir), M.SUM, V.read_bound(SEQ, 6500, remote=True, snapshot=8000))


def _tracker_sql(interval_s: int) -> str:
    return f""", secs AS MATERIALIZED (SELECT create_ts // 1000 AS ts, min(seq) AS seq FROM log GROUP BY 1),
kept AS (SELECT 0 AS i, (SELECT min(ts) FROM secs) AS ts UNION ALL SELECT i + 1, (SELECT min(s.ts) FROM secs s WHERE s.ts >= kept.ts + {interval_s}) FROM kept WHERE (SELECT min(s.ts) FROM secs s WHERE s.ts >= kept.ts + {interval_s}) IS NOT NULL),
halved AS (SELECT CASE WHEN max(i) < 8192 THEN 0 ELSE 1 + (max(i) - 8192) // 4096 END AS h FROM kept),
entered AS (SELECT i, ts, CASE WHEN i <= 8192 THEN 0 ELSE (i - 8192 + 4095) // 4096 END AS j FROM kept),
tracker AS MATERIALIZED (SELECT s.seq, s.ts FROM entered e CROSS JOIN halved JOIN secs s ON s.ts = e.ts WHERE (e.i - 4096 * e.j) % (1 << (h - e.j)) = 0)"""


#: The lookups go over a tracker of a sample an hour, which SQL can follow step by step; tracker_sampling has the default interval.
HOUR_S = 3600
_TRACKER = _tracker_sql(HOUR_S)


@_query(_TRACKER + f1(where="seq <= (SELECT seq FROM tracker WHERE ts <= 1704499200 ORDER BY ts DESC LIMIT 1)") + STATE)
def time_travel_by_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    probe = spark.createDataFrame([(1_704_499_200,)], "ts long")
    bound = Q.ts_to_seq(probe, Q.build_tracker(log, HOUR_S), up=False).select(F.col("seq").alias("_bound"))  # one row
    seen = log.crossJoin(F.broadcast(bound)).where(F.col("seq") <= F.col("_bound"))
    return V.visible(seen.drop("_bound"), M.SUM)


@_query(
    """, own AS (SELECT key, CASE WHEN key % 5 = 0 THEN 'T' WHEN key % 5 = 1 THEN 'M' ELSE 'V' END AS kind, CASE WHEN key % 5 <> 0 THEN 1000 + key END AS value, 9223372036854775807 AS seq, CAST(NULL AS BIGINT) AS create_ts, CAST(NULL AS BIGINT) AS expire_ts
                   FROM (SELECT DISTINCT key FROM log WHERE key % 2 = 0)),
        joined AS (SELECT key, kind, value, seq, create_ts, expire_ts FROM log WHERE seq <= 9000 UNION ALL SELECT * FROM own)"""
    + f1(source="joined")
    + STATE
)
def overlay_txn_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    k = F.col("key")
    kind = F.when(k % 5 == 0, TOMBSTONE).when(k % 5 == 1, MERGE).otherwise(VALUE)
    own = as_log(log.where("key % 2 = 0").select("key").distinct(), k, kind, (1000 + k).cast("long"), F.lit(0), op_idx=F.lit(0))
    return V.overlay(log, own, SEQ, M.SUM)


@_query("SELECT source_rank, key, kind, value, seq FROM log WHERE key >= 10 AND key < 20 AND seq <= 9000")
def recency_scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scan_by_recency(ranked(event_log(spark, sf_dir)), KeyRange(included(10), excluded(20)), SEQ, segment="segment")
    return rows.select("source_rank", "key", "kind", "value", "seq")


# -- merge operators

_MERGES: dict[str, tuple[M.MergeOperator, str]] = {
    "sum": (M.SUM, "CAST(sum(value) AS BIGINT)"),
    "count": (M.COUNT, "CAST(sum(CASE WHEN value IS NOT NULL THEN 1 END) AS BIGINT)"),
    "min": (M.MIN, "min(value)"),
    "max": (M.MAX, "max(value)"),
    "first": (M.FIRST, "arg_min(value, seq) FILTER (WHERE value IS NOT NULL)"),
    "last": (M.LAST, "arg_max(value, seq) FILTER (WHERE value IS NOT NULL)"),
    "concat": (M.concat(","), "string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq)"),
    "max_by_version": (M.max_by_version(lambda v: v % 97), "arg_max(value, (value % 97) * 100000000 + seq) FILTER (WHERE value IS NOT NULL)"),
}


def _merge_query(name: str, op: M.MergeOperator, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.visible(op.entered(event_log(spark, sf_dir)), op)

    run.__name__ = f"merge_{name}"
    _query(f1(sql) + STATE)(run)


for _name, (_op, _sql) in _MERGES.items():
    _merge_query(_name, _op, _sql)


def _joined(df: DataFrame) -> DataFrame:
    """Lists as text."""
    return df.withColumn("value", F.array_join(F.col("value").cast("array<string>"), ",")) if df.schema["value"].dataType.typeName() == "array" else df


def _after_compaction(name: str, op: M.MergeOperator, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = op.entered(event_log(spark, sf_dir))
        if op.name == "concat":
            log = log.withColumn("value", F.col("value").cast("string"))
        return _joined(V.visible(C.compact([log], op, oldest=True), op))

    run.__name__ = f"merge_{name}_after_compaction"
    _query(f1(sql) + STATE)(run)


_LISTS = {
    "append": (M.APPEND, "string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq)"),
    "set_union": (M.SET_UNION, "array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL)), ',')"),
}
for _name, (_op, _sql) in ({n: _MERGES[n] for n in ("count", "concat")} | _LISTS).items():
    _after_compaction(_name, _op, _sql)


@_query(f1() + "SELECT key, create_ts, expire_ts, seq FROM state")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(event_log(spark, sf_dir), M.SUM).select("key", "create_ts", "expire_ts", "seq")


@_query(f1("CAST(CASE key % 3 WHEN 0 THEN sum(value) WHEN 1 THEN max(value) ELSE min(value) END AS BIGINT)") + STATE)
def merge_routed_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = M.routed([(lambda k: k % 3 == 0, M.SUM), (lambda k: k % 3 == 1, M.MAX)], M.MIN)
    return V.visible(event_log(spark, sf_dir), op)


@_query(
    """, x AS (SELECT seq AS op_idx, kind, key, value, max(CASE WHEN kind <> 'M' THEN seq END) OVER (PARTITION BY key) AS base FROM log)
    SELECT key, CASE WHEN count(*) = 1 THEN max(kind) WHEN bool_or(kind <> 'M') THEN 'V' ELSE 'M' END AS kind, CAST(sum(value) AS BIGINT) AS value, CAST(10001 AS BIGINT) AS seq
    FROM x WHERE base IS NULL OR op_idx >= base GROUP BY key"""
)
def batch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as one write batch."""
    op = F.when(F.col("kind") == VALUE, "put").when(F.col("kind") == MERGE, "merge").otherwise("delete")
    ops = event_log(spark, sf_dir).select(F.col("seq").alias("op_idx"), op.alias("op"), "key", "value", F.lit(None).cast("long").alias("expire_ts"))
    return C.collapse_batch(ops, M.SUM, 10_001, NOW).select("key", "kind", "value", "seq")


# -- flush and compaction


def f2(barrier: str = "NULL", source: str = "log") -> str:
    return f""", s AS (SELECT key, kind, value, seq, create_ts, expire_ts, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> 'M' OR coalesce(lag(seq) OVER w > {barrier}, FALSE) OR lag(expire_ts) OVER w IS DISTINCT FROM expire_ts THEN 1 ELSE 0 END AS start
       FROM {source} WINDOW w AS (PARTITION BY key ORDER BY seq DESC)),
    g AS (SELECT *, sum(start) OVER (PARTITION BY key ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS gid FROM s),
    folded AS (SELECT key, CASE WHEN count(*) = 1 THEN max(kind) WHEN bool_or(kind <> 'M') THEN 'V' ELSE 'M' END AS kind, CAST(sum(value) AS BIGINT) AS value, max(seq) AS seq, max(create_ts) AS create_ts, max(expire_ts) AS expire_ts FROM g GROUP BY key, gid)"""


def f3(now: str = "NULL", min_seq: str = "NULL", window: str = "FALSE", drop_tail: bool = False, source: str = "folded") -> str:
    tail = "QUALIFY sum(CASE WHEN kind <> 'T' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0" if drop_tail else ""
    return f""", r1 AS (SELECT *, coalesce(expire_ts <= {now}, FALSE) AS expired, CASE WHEN kind <> 'M' AND NOT coalesce(seq > {min_seq}, FALSE) AND NOT ({window}) THEN 1 ELSE 0 END AS stop FROM {source}),
    r2 AS (SELECT key, CASE WHEN kind = 'V' AND expired THEN 'T' ELSE kind END AS kind, CASE WHEN NOT (kind = 'V' AND expired) THEN value END AS value, seq, create_ts, CASE WHEN NOT (kind = 'V' AND expired) THEN expire_ts END AS expire_ts, stop FROM r1 WHERE NOT (kind = 'M' AND expired)),
    r3 AS (SELECT *, sum(stop) OVER (PARTITION BY key ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r2),
    r4 AS (SELECT key, kind, value, seq, create_ts, expire_ts FROM r3 WHERE coalesce(before, 0) = 0),
    retained AS (SELECT * FROM r4 {tail})"""


ROWS = "SELECT key, kind, value, seq, create_ts, expire_ts FROM "


@_query(f2(str(BARRIER)) + ROWS + "folded")
def flush_collapse_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(event_log(spark, sf_dir), M.SUM, BARRIER)


@_query(f3(min_seq=str(MIN_SEQ), source="log") + ROWS + "retained")
def retention_min_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retain(event_log(spark, sf_dir), min_seq=MIN_SEQ)


@_query(f3(now=str(NOW), min_seq="0", source="log") + ROWS + "retained")
def ttl_expire_to_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retain(event_log(spark, sf_dir), now=NOW, min_seq=0)


@_query(f3(now=str(NOW), drop_tail=True, source="log") + ROWS + "retained")
def drop_tail_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retain(event_log(spark, sf_dir), now=NOW, drop_tail=True)


@_query(_TRACKER + ", timed AS (SELECT *, (SELECT min(t.ts) FROM tracker t WHERE t.seq >= log.seq) * 1000 AS sys_ts FROM log)" + f3(window=f"coalesce(sys_ts, {NOW}) + {5 * DAY} > {NOW}", source="timed") + ROWS + "retained")
def retention_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    times = Q.seq_to_ts(log.select("seq"), Q.build_tracker(log, HOUR_S), up=True)
    timed = log.join(times, "seq", "left")
    return C.retain(timed, timeout_ms=5 * DAY, clock=NOW, row_time=F.col("ts") * 1000)


@_query(f2(str(BARRIER)) + f3(now=str(NOW), min_seq=str(BARRIER), drop_tail=True) + ROWS + "retained")
def compaction_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    parts = [log.where(F.col("seq") % 3 == i) for i in range(3)]
    return C.compact(parts, M.SUM, NOW, BARRIER, BARRIER, oldest=True)


@_query(
    f2()
    + f3()
    + "SELECT key, CASE WHEN key % 11 = 1 THEN 'T' WHEN key % 11 = 2 THEN 'V' ELSE kind END AS kind, CASE WHEN key % 11 = 1 THEN NULL WHEN key % 11 = 2 THEN -1 ELSE value END AS value, seq, create_ts, CASE WHEN key % 11 <> 1 AND NOT (key % 11 > 2 AND kind = 'T') THEN expire_ts END AS expire_ts FROM retained WHERE key % 11 <> 0"
)
def compaction_filter_keep_drop_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key") % 11
    decide = F.when(k == 0, C.DROP).when(k == 1, TOMBSTONE).when(k == 2, VALUE).otherwise(C.KEEP)
    return C.compact([event_log(spark, sf_dir)], M.SUM, decide=decide, value=F.lit(-1).cast("long"))


@_query(f1() + STATE + f" WHERE expire_ts IS NULL OR expire_ts > {NOW}")
def strict_ttl_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible(event_log(spark, sf_dir), M.SUM).where(ttl.not_expired(F.col("expire_ts"), F.lit(NOW)))


@_query(
    """SELECT seq, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN create_ts + seq * 1000 ELSE seq * 5 END AS expire_ts,
    CASE WHEN seq % 4 = 0 THEN create_ts + 3600000 END AS default_expire_ts FROM log"""
)
def ttl_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") % 4
    kind = F.when(n == 0, "default").when(n == 1, "no_expiry").when(n == 2, "after_ms").otherwise("at_ms")
    value = F.when(n == 2, F.col("seq") * 1000).otherwise(F.col("seq") * 5)
    return event_log(spark, sf_dir).select("seq", ttl.expire_ts(kind, value, F.col("create_ts")).alias("expire_ts"), F.when(n == 0, ttl.expire_ts(kind, value, F.col("create_ts"), 3_600_000)).alias("default_expire_ts"))


# -- sequence numbers and time


def _lookup(name: str, up: bool, to_ts: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = event_log(spark, sf_dir)
        if to_ts:
            return Q.seq_to_ts(log.select((F.col("seq") + 1).alias("probe")), Q.build_tracker(log, HOUR_S), "probe", up, "found")
        return Q.ts_to_seq(log.select((F.floor(F.col("create_ts") / 1000) + 1800).alias("probe")), Q.build_tracker(log, HOUR_S), "probe", up, "found")

    run.__name__ = name
    probe = "seq + 1" if to_ts else "create_ts // 1000 + 1800"
    by, give = ("seq", "ts") if to_ts else ("ts", "seq")
    agg, cmp = ("arg_min", ">=") if up else ("arg_max", "<=")
    _query(_TRACKER + f", p AS (SELECT DISTINCT {probe} AS probe FROM log) SELECT probe, (SELECT {agg}(t.{give}, t.{by}) FROM tracker t WHERE t.{by} {cmp} p.probe) AS found FROM p")(run)


for _dir in ("up", "down"):
    _lookup(f"seq_to_ts_{_dir}", _dir == "up", True)
    _lookup(f"ts_to_seq_{_dir}", _dir == "up", False)


@_query(_tracker_sql(60) + " SELECT seq, ts FROM tracker")
def tracker_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default interval; beyond the capacity every second sample goes, the last one never."""
    return Q.build_tracker(event_log(spark, sf_dir))


# -- transactions: a transaction per forty events, over users


def _txns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    log = event_log(spark, sf_dir)
    t = F.floor(F.col("seq") / 40)
    txns = log.groupBy(t.alias("txn_id")).agg(F.min("seq").alias("started_seq"), (F.max("seq") + 25).alias("committed_seq")).withColumn("isolation", F.when(F.col("txn_id") % 2 == 0, "SSI").otherwise("SI"))
    writes = log.where("kind <> 'V'").select(t.alias("txn_id"), "key").distinct()
    reads = log.where("kind = 'V'").select(t.alias("txn_id"), "key").distinct()
    ranges = txns.select("txn_id", (F.col("txn_id") * 13 % 140).alias("lo"), (F.col("txn_id") * 13 % 140 + 3).alias("hi"), F.lit(False).alias("lo_open"), F.lit(True).alias("hi_open"))
    return txns, writes, reads, ranges


#: All tombstones and operands write, all values are read.
_TXN = """, txns AS (SELECT seq // 40 AS txn_id, min(seq) AS started_seq, max(seq) + 25 AS committed_seq, CASE WHEN (seq // 40) % 2 = 0 THEN 'SSI' ELSE 'SI' END AS isolation FROM log GROUP BY seq // 40),
writes AS (SELECT DISTINCT seq // 40 AS txn_id, key FROM log WHERE kind <> 'V'), reads AS (SELECT DISTINCT seq // 40 AS txn_id, key FROM log WHERE kind = 'V'),
others AS (SELECT w.txn_id AS other, w.key AS other_key, t.committed_seq AS other_seq FROM writes w JOIN txns t USING (txn_id)),
ranges AS (SELECT txn_id, txn_id * 13 % 140 AS lo, txn_id * 13 % 140 + 3 AS hi FROM txns) """


_WW = "SELECT DISTINCT w.txn_id, w.key FROM writes w JOIN txns t USING (txn_id) JOIN others o ON o.other_key = w.key AND o.other_seq > t.started_seq AND o.other <> w.txn_id"
_RW = "SELECT DISTINCT w.txn_id, w.key FROM reads w JOIN txns t ON w.txn_id = t.txn_id AND t.isolation = 'SSI' JOIN others o ON o.other_key = w.key AND o.other_seq > t.started_seq AND o.other <> w.txn_id"
_PHANTOM = "SELECT DISTINCT r.txn_id, r.lo, r.hi FROM ranges r JOIN txns t ON r.txn_id = t.txn_id AND t.isolation = 'SSI' JOIN others o ON o.other_key >= r.lo AND o.other_key < r.hi AND o.other_seq > t.started_seq AND o.other <> r.txn_id"
_FREE = ", bad AS (SELECT DISTINCT w.txn_id FROM writes w JOIN txns t USING (txn_id) JOIN others o ON o.other_key = w.key AND o.other_seq > t.started_seq AND o.other <> w.txn_id) SELECT txn_id FROM txns WHERE txn_id NOT IN (SELECT txn_id FROM bad)"


@_query(_TXN + _WW)
def txn_ww_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, writes, _, _ = _txns(spark, sf_dir)
    return X.write_conflicts(txns, writes)


@_query(_TXN + _RW)
def txn_rw_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, writes, reads, _ = _txns(spark, sf_dir)
    return X.read_conflicts(txns, reads, writes)


@_query(_TXN + _PHANTOM)
def txn_phantom_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, writes, _, ranges = _txns(spark, sf_dir)
    return X.phantom_conflicts(txns, ranges, writes)


@_query(_TXN + _FREE)
def txn_committable(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, writes, _, _ = _txns(spark, sf_dir)
    return X.committable(txns, X.write_conflicts(txns, writes)).select("txn_id")


# -- segments, projection, union


@_query("SELECT segment, count(*) AS versions, min(key) AS min_key, max(key) AS max_key, max(seq) AS last_seq FROM log GROUP BY segment")
def segment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.listing(event_log(spark, sf_dir))


@_query(f1(where="key = 23") + STATE)
def segment_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a segmented store: only files that hold its segment are read."""
    store = _loaded(spark, sf_dir, segment=lambda k: F.floor(k / 10))
    store.flush()
    m = store.manifest()
    pruned = store.pruned(m, KeyRange.point(23))
    if len(m.files) > 1 and len(pruned.files) > 1:
        raise AssertionError("other segments would be read")
    return store.get(23)


_PREFIXES = "SELECT DISTINCT substr(c_name, 1, CASE WHEN c_custkey % 40 = 0 THEN 15 ELSE 18 END) AS prefix FROM customer"


@_query(f"WITH p AS ({_PREFIXES}) SELECT a.prefix AS \"outer\", b.prefix AS \"inner\" FROM p a JOIN p b ON starts_with(b.prefix, a.prefix) AND a.prefix <> b.prefix")
def segment_antichain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return G.antichain_violations(c.select(F.when(F.col("c_custkey") % 40 == 0, F.substring("c_name", 1, 15)).otherwise(F.substring("c_name", 1, 18)).alias("prefix")))


@_query(ROWS + "log WHERE key >= 30 AND key < 60 AND segment IN (3, 4)")
def project_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.project(event_log(spark, sf_dir), KeyRange(included(30), excluded(60)), [3, 4]).select("key", "kind", "value", "seq", "create_ts", "expire_ts")


@_query(ROWS + "log WHERE key < 30 OR key >= 60")
def union_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("key", "kind", "value", "seq", "create_ts", "expire_ts")
    return G.union_disjoint([log.where("key < 30"), log.where("key >= 60")])


@_query(", b AS (SELECT source_rank AS name, min(key) AS lo, max(key) AS hi FROM log GROUP BY source_rank) SELECT b.name, (SELECT count(*) FROM b c WHERE (c.lo, c.name) < (b.lo, b.name) AND c.hi >= b.lo) > 0 AS overlaps FROM b")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = ranked(event_log(spark, sf_dir)).groupBy(F.col("source_rank").alias("name")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    met = G.overlaps(bounds).select(F.col("right").alias("name"), F.lit(True).alias("overlaps"))
    return bounds.join(met, "name", "left").select("name", F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


@_query(", f AS (SELECT seq // 50 AS f, min(key) AS lo, max(key) AS hi FROM log GROUP BY 1), e AS (SELECT DISTINCT lo AS at FROM f) SELECT max(n) AS depth FROM (SELECT (SELECT count(*) FROM f WHERE f.lo <= e.at AND f.hi >= e.at) AS n FROM e)")
def l0_overlap_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = event_log(spark, sf_dir).groupBy(F.floor(F.col("seq") / 50)).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return G.overlap_depth(files)


# -- inspection


@_query(
    "SELECT source_rank, count(*) FILTER (WHERE kind = 'V') AS num_puts, count(*) FILTER (WHERE kind = 'T') AS num_deletes, count(*) FILTER (WHERE kind = 'M') AS num_merges, CAST(sum(length(CAST(key AS VARCHAR))) AS BIGINT) AS raw_key_size, CAST(coalesce(sum(length(CAST(value AS VARCHAR))), 0) AS BIGINT) AS raw_value_size FROM log GROUP BY source_rank"
)
def sst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.file_stats(ranked(event_log(spark, sf_dir)), by="source_rank")


@_query(", i AS (SELECT segment, min(key) AS first_key, max(key) AS last_key, count(*) AS rows FROM log GROUP BY segment) SELECT * FROM i WHERE last_key >= 77 ORDER BY first_key LIMIT 1")
def file_index_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.lower_bound(inspect.index(event_log(spark, sf_dir), by="segment"), 77, by="segment")


# -- stores


#: The events in four parts of equal spans of sequence numbers, as four write batches.
PARTS = 4
_PART = f", part AS (SELECT *, (seq - 1) // (1 + (SELECT max(seq) - 1 FROM log) // {PARTS}) + 1 AS batch FROM log)"


def _parts(log: DataFrame) -> list[DataFrame]:
    last = log.agg(F.max("seq")).first()[0] or 0
    span = 1 + (last - 1) // PARTS
    return [log.where((F.col("seq") > span * k) & (F.col("seq") <= span * (k + 1))) for k in range(PARTS)]


def _store(spark: SparkSession, **options: Any) -> Store:
    return Store(spark, scratch(spark), M.SUM, key=T.LongType(), value=T.LongType(), **options).open_writer()


def _loaded(spark: SparkSession, sf_dir: str, **options: Any) -> Store:
    store = _store(spark, **options)
    for part in _parts(event_log(spark, sf_dir)):
        store.load(part)
    return store


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(_PART + " SELECT batch, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(value) AS BIGINT) AS total FROM part GROUP BY 1")
def cdc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [rows.agg(F.lit(n).cast("long").alias("batch"), F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("value").alias("total")) for n, rows in cdc.batches(_loaded(spark, sf_dir))]
    return _all(found)


@_query(_PART + " SELECT key, kind, value, seq FROM part WHERE batch > 2")
def cdc_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cursor after the second batch still has to see."""
    return _all([rows for _, rows in cdc.batches(_loaded(spark, sf_dir), cursor=2)]).select("key", "kind", "value", "seq")


@_query(_PART + " " + ROWS + "part WHERE batch > 2")
def wal_replay_after_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening a store replays: the batches since the last flush."""
    store = _store(spark)
    for k, part in enumerate(_parts(event_log(spark, sf_dir))):
        store.load(part)
        if k == 1:
            store.flush()
    return store.replay()


@_query(f1() + STATE)
def store_compacted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible state after four flushes, a compaction and a fifth of the files in the write-ahead log."""
    store = _store(spark)
    for k, part in enumerate(_parts(event_log(spark, sf_dir))):
        store.load(part)
        if k < 3:
            store.flush()
    store.compact()
    return store.scan()


@_query(_PART + f1(where="batch <= 2", source="part") + STATE)
def store_snapshot_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first half, read after the rest was written, flushed and compacted."""
    store, parts = _store(spark), _parts(event_log(spark, sf_dir))
    for part in parts[:2]:
        store.load(part)
    snapshot = store.snapshot()
    for part in parts[2:]:
        store.load(part)
        store.flush()
    store.compact()
    store.collect_garbage(min_age_ms=0)
    return snapshot.scan()


@_query(f1() + STATE)
def store_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that was taken over can neither add nor destroy anything."""
    store = _loaded(spark, sf_dir)
    other = Store(spark, store.root, M.SUM, key=T.LongType(), value=T.LongType()).open_writer()
    try:
        store.put(1, 1)
    except Fenced:
        return other.scan()
    raise AssertionError("the older writer was not fenced")


_ASKED = (1, 2, 3, 10**9)


@_query(_PART + f" SELECT k AS key, EXISTS (SELECT 1 FROM part WHERE batch > 2 AND key = k) AS conflict FROM (SELECT unnest([{', '.join(map(str, _ASKED))}]) AS k)")
def store_txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions begun after the first half, each writing one key, committed after the rest was written and compacted."""
    store, parts = _store(spark), _parts(event_log(spark, sf_dir))
    for part in parts[:2]:
        store.load(part)
    open_ = [(k, store.begin()) for k in _ASKED]
    for part in parts[2:]:
        store.load(part)
        store.flush()
    store.compact()
    rows = []
    for k, t in open_:
        t.put(k, 5)
        try:
            t.commit()
            rows.append((k, False))
        except Conflict:
            t.rollback()
            rows.append((k, True))
    return spark.createDataFrame(rows, "key long, conflict boolean")


@_query(f1(where="key < 50") + STATE)
def store_clone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clones of a store, clipped to neighbouring ranges of keys, made one again."""
    store = _loaded(spark, sf_dir)
    store.flush()
    left, right = store.clone(scratch(spark), clip="key < 20"), store.clone(scratch(spark), clip="key >= 20 and key < 50")
    return Store.union(scratch(spark), [left, right]).scan()


@_query(f1() + STATE)
def cdc_materialize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as four folders, consumed by a stream with an idempotent sink, and read back."""
    root = scratch(spark)
    log = event_log(spark, sf_dir).select(*COLUMNS)
    for k, part in enumerate(_parts(log), 1):
        part.write.parquet(f"{root}/wal/{k:020d}")
    rows = cdc.stream(spark, f"{root}/wal", log.schema).drop("batch")
    cdc.materialize_latest(rows, f"{root}/sink", f"{root}/state").awaitTermination()
    return V.visible(spark.read.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{root}/sink"), M.SUM)


# -- housekeeping


@_query("SELECT * FROM (VALUES ('data', CAST(3 AS BIGINT)), ('wal', CAST(3 AS BIGINT))) AS t(folder, unused)")
def gc_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After three flushes, a compaction and a fourth batch: three files and three batches that nothing needs any more."""
    store = _store(spark)
    for k, part in enumerate(_parts(event_log(spark, sf_dir))):
        store.load(part)
        if k < 3:
            store.flush()
    store.compact()
    old = [p.removeprefix(store.root + "/").split("/")[0] for p in store.collect_garbage(min_age_ms=0, dry_run=True)]
    return spark.createDataFrame([(n, old.count(n)) for n in ("data", "wal")], "folder string, unused long")


@_query(_PART + f" SELECT 'c' || batch AS name, max(seq) AS seq, CASE WHEN batch < 4 THEN CAST({NOW} + batch * 1000 AS BIGINT) END AS expire_ts FROM part WHERE batch > 2 GROUP BY batch")
def checkpoint_list_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint after each batch, the later the longer; two seconds on, the first two are over."""
    store = _store(spark)
    for k, part in enumerate(_parts(event_log(spark, sf_dir)), 1):
        store.load(part)
        store.create_checkpoint(f"c{k}", k * 1000 if k < PARTS else None, NOW)
    return inspect.checkpoints(store, NOW + 2000).select("name", "seq", "expire_ts")


_BANK_BOUNDS = (1000, 3000, 5000, 7000, 9000, 10000)


@_query(
    f""", bounds AS (SELECT unnest([{', '.join(map(str, _BANK_BOUNDS))}]) AS bound UNION SELECT max(seq) FROM log),
    legs AS (SELECT key, -(value % 100) AS delta, seq FROM log WHERE value IS NOT NULL UNION ALL SELECT (key + 1) % 150 AS key, value % 100 AS delta, seq FROM log WHERE value IS NOT NULL)
    SELECT bound, CAST(sum(delta) AS BIGINT) AS total, count(DISTINCT key) AS accounts FROM bounds JOIN legs ON legs.seq <= bound GROUP BY bound"""
)
def bank_total_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers as paired operands: the total is zero at every bound, the last sequence number among them."""
    log = event_log(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last")).first().last
    log = log.where("value is not null")
    amount = F.col("value") % 100
    legs = log.select("seq", "create_ts", "expire_ts", F.explode(F.array(F.struct(F.col("key").alias("key"), (-amount).alias("value")), F.struct(((F.col("key") + 1) % 150).alias("key"), amount.alias("value")))).alias("leg"))
    legs = legs.select(F.col("leg.key").alias("key"), F.lit(MERGE).alias("kind"), F.col("leg.value").alias("value"), "seq", "create_ts", "expire_ts")
    views = [V.visible(legs, M.BALANCE, bound).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("accounts")).select(F.lit(bound).alias("bound"), "total", "accounts") for bound in sorted({*_BANK_BOUNDS, *([] if last is None else [last])})]
    return _all(views)


# -- codecs


@_query(
    """SELECT seq, upper(lpad(to_hex(seq), 16, '0')) AS u64_hex, CASE WHEN seq - 5000 >= 0 THEN '8' || substr(lpad(upper(to_hex(seq - 5000)), 16, '0'), 2) ELSE '7FFFFFFFFFFF' || lpad(upper(to_hex(65536 + (seq - 5000))), 4, '0') END AS i64_hex,
    hex(encode(event_type)) AS text_hex, seq AS u64_back, seq - 5000 AS i64_back FROM log"""
)
def codec_roundtrip_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    s = F.col("seq")
    u, i = codecs.u64(s), codecs.i64(s - 5000)
    return log.select("seq", F.hex(u).alias("u64_hex"), F.hex(i).alias("i64_hex"), F.hex(codecs.text(F.col("event_type"))).alias("text_hex"), codecs.u64_decode(u).alias("u64_back"), codecs.i64_decode(i).alias("i64_back"))


@_query("SELECT event_id, user_id, value AS back, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id) AS place FROM events")
def codec_f64_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in the order of their encoded keys; nulls stay null and come first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", codecs.f64("value").alias("k"))
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("k"), "event_id")
    return e.select("event_id", "user_id", codecs.f64_decode("k").alias("back"), F.row_number().over(w).cast("long").alias("place"))


@_query("WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1) SELECT count(*) AS rows, CAST(sum(strlen(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS key_bytes, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes FROM s")
def cli_count_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's scan --count over a store of orders."""
    from ..__main__ import counted

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    store = Store(spark, scratch(spark)).open_writer()
    binary = lambda c: codecs.text(F.col(c).cast("string"))
    store.load(as_log(o, binary("o_custkey"), F.lit(VALUE), binary("o_orderstatus"), F.col("o_orderkey") + 1))
    return counted(store.scan())


@_query(
    ", c AS (SELECT conv_id AS key, turn, role || ':' || length(text) AS part FROM conversations) SELECT key, string_agg(part, '|' ORDER BY turn, part) AS value, count(*) AS parts FROM c GROUP BY key"
)
def merge_append_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns appended to a list."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = F.concat(F.col("role"), F.lit(":"), F.char_length("text").cast("string"))
    log = as_log(c, F.col("conv_id"), F.lit(MERGE), part, F.col("turn"), op_idx=part)
    return V.visible(M.APPEND.entered(log), M.APPEND).select("key", F.array_join("value", "|").alias("value"), F.size("value").cast("long").alias("parts"))
