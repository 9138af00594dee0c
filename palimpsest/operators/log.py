"""The versioned row log: one row per put, delete or merge operand of a key, ordered by sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE, MERGE, TOMBSTONE = "V", "M", "T"
#: Sequence number of a transaction's own uncommitted rows.
UNCOMMITTED = (1 << 63) - 1
COLUMNS = ("key", "kind", "value", "seq", "create_ts", "expire_ts")


def schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("key", key or T.BinaryType(), False),
            T.StructField("kind", T.StringType(), False),
            T.StructField("value", value or T.BinaryType()),
            T.StructField("seq", T.LongType(), False),
            T.StructField("create_ts", T.LongType()),
            T.StructField("expire_ts", T.LongType()),
        ]
    )


class LogError(Exception):
    """A request that the log's rules refuse."""


def as_log(df: DataFrame, key: Column, kind: Column, value: Column, seq: Column, create_ts: Column | None = None, expire_ts: Column | None = None, **more: Column) -> DataFrame:
    """Any table as a log. Further columns are carried along."""
    none = F.lit(None).cast("long")
    return df.select(
        key.alias("key"),
        kind.alias("kind"),
        F.when(kind != TOMBSTONE, value).alias("value"),
        seq.cast("long").alias("seq"),
        (none if create_ts is None else create_ts.cast("long")).alias("create_ts"),
        (none if expire_ts is None else F.when(kind != TOMBSTONE, expire_ts.cast("long"))).alias("expire_ts"),
        *(c.alias(n) for n, c in more.items()),
    )


def order_of(log: DataFrame) -> Column:
    """What orders the versions of a key: the sequence number, and the place within a batch where there is one."""
    return F.struct("seq", "op_idx") if "op_idx" in log.columns else F.col("seq")


def violations(log: DataFrame) -> DataFrame:
    """Rows that break the log's rules, with the rule that they break."""
    size = F.octet_length("key") if isinstance(log.schema["key"].dataType, (T.BinaryType, T.StringType)) else F.lit(1)
    rule = (
        F.when(F.col("key").isNull() | (size < 1) | (size > 65535), "key length")
        .when(~F.col("kind").isin(VALUE, MERGE, TOMBSTONE), "kind")
        .when((F.col("kind") == TOMBSTONE) != F.col("value").isNull(), "value")
        .when((F.col("kind") == TOMBSTONE) & F.col("expire_ts").isNotNull(), "tombstone with expiry")
        .when((F.col("seq") < 0) | (F.col("seq") == UNCOMMITTED), "sequence number")
    )
    return log.withColumn("rule", rule).where("rule is not null")
