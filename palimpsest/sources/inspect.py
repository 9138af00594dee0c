"""What a store consists of, as tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store


def file_stats(log: DataFrame, by: str = "_file") -> DataFrame:
    """Counts and raw sizes of each file's rows. Without a column `by`, the file that a row was read from."""
    rows = log if by in log.columns else log.withColumn(by, F.input_file_name())
    size = lambda c: F.octet_length(F.col(c).cast("string")) if log.schema[c].dataType.typeName() != "binary" else F.octet_length(c)
    return rows.groupBy(by).agg(
        F.count_if(F.col("kind") == "V").alias("num_puts"),
        F.count_if(F.col("kind") == "T").alias("num_deletes"),
        F.count_if(F.col("kind") == "M").alias("num_merges"),
        F.sum(size("key")).cast("long").alias("raw_key_size"),
        F.coalesce(F.sum(size("value")), F.lit(0)).cast("long").alias("raw_value_size"),
    )


def index(log: DataFrame, by: str = "_file") -> DataFrame:
    """first_key and last_key of each file, in key order."""
    rows = log if by in log.columns else log.withColumn(by, F.input_file_name())
    return rows.groupBy(by).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("rows"))


def lower_bound(indexed: DataFrame, key: Any, by: str = "_file") -> DataFrame:
    """The first file whose last key is not below a key."""
    return indexed.where(F.col("last_key") >= F.lit(key)).orderBy("first_key", by).limit(1)


def positions(indexed: DataFrame, by: str = "_file") -> DataFrame:
    return indexed.withColumn("position", F.row_number().over(Window.orderBy("first_key", by)) - 1)  # one row per file


def manifests(store: Store, first: int | None = None, last: int | None = None) -> DataFrame:
    rows = []
    for name, t in store.files.names(f"{store.root}/manifest"):
        n = int(name.split(".")[0])
        if (first is None or n >= first) and (last is None or n <= last):
            m = store.manifest(n)
            rows.append((n, m.epoch, m.last_seq, m.replayed_wal, len(m.files), len(m.checkpoints), t))
    return store.spark.createDataFrame(rows, "manifest_id long, writer_epoch long, last_seq long, replay_after_wal_id long, files int, checkpoints int, written_ms long")


def checkpoints(store: Store, now_ms: int | None = None) -> DataFrame:
    rows = [(c["id"], c["manifest"], c["seq"], c["create_ts"], c["expire_ts"], c["name"]) for c in store.manifest().checkpoints if now_ms is None or c["expire_ts"] is None or c["expire_ts"] > now_ms]
    return store.spark.createDataFrame(rows, "id string, manifest_id long, seq long, create_ts long, expire_ts long, name string")


def files(store: Store) -> DataFrame:
    rows = [(f["path"], f["segment"], f["level"], f["run"], i, f["size"], f.get("clip")) for i, f in enumerate(store.manifest().files)]
    return store.spark.createDataFrame(rows, "path string, segment string, level int, run_id long, position int, size long, clip string")


def wal_files(store: Store) -> DataFrame:
    """Committed write batches that are still there."""
    times = dict(store.files.names(f"{store.root}/wal"))
    rows = [(w["number"], store.files.size(w["path"]), times.get(w["path"].rsplit("/", 1)[-1])) for w in store.manifest().wal]
    return store.spark.createDataFrame(rows, "batch long, size long, written_ms long")


def segments(store: Store) -> DataFrame:
    return files(store).groupBy("segment").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("run_id").alias("last_run"))


def status(store: Store) -> DataFrame:
    m = store.manifest()
    row = (m.id, m.epoch, m.last_seq, m.persisted_seq, len(m.unflushed()), len(m.files))
    return store.spark.createDataFrame([row], "manifest_id long, writer_epoch long, last_seq long, persisted_seq long, unflushed_batches long, files int")


def observed(df: DataFrame, name: str) -> DataFrame:
    """The same rows, with counts reported to query listeners."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "T").alias("deletes"), F.max("seq").alias("last_seq"))
