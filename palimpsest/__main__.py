"""A command line over stores: python -m palimpsest COMMAND ROOT ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .functions.ranges import UNBOUNDED, KeyRange, excluded, included
from .operators import merge_ops, seqtime
from .sources import inspect
from .sources.store import Store


def counted(rows: DataFrame) -> DataFrame:
    """rows, key_bytes and value_bytes of a scan."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("key")).cast("long").alias("key_bytes"), F.sum(F.octet_length("value")).cast("long").alias("value_bytes"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimpsest")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "manifests", "checkpoints", "files", "segments", "status", "wal", "seq-to-ts", "ts-to-seq", "checkpoint", "refresh-checkpoint", "delete-checkpoint", "flush", "compact", "compact-all", "clone", "gc", "destroy", "put", "delete"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("--merge", choices=sorted(merge_ops.REGISTRY))
        if name == "scan":
            c.add_argument("--prefix")
            c.add_argument("--from", dest="low")
            c.add_argument("--to", dest="high")
            c.add_argument("--checkpoint")
            c.add_argument("--max-keys", type=int)
            c.add_argument("--count", action="store_true")
            c.add_argument("--keys", choices=["auto", "hex", "utf8", "len", "none"], default="auto")
            c.add_argument("--values", choices=["auto", "hex", "utf8", "len", "none"], default="auto")
        if name in ("checkpoint", "refresh-checkpoint", "delete-checkpoint"):
            c.add_argument("name")
        if name in ("checkpoint", "refresh-checkpoint"):
            c.add_argument("--lifetime-ms", type=int)
        if name in ("seq-to-ts", "ts-to-seq"):
            c.add_argument("at", type=int)
            c.add_argument("--down", action="store_true")
        if name == "clone":
            c.add_argument("target")
            c.add_argument("--checkpoint")
        if name == "gc":
            c.add_argument("--min-age-ms", type=int)
        if name in ("gc", "destroy"):
            c.add_argument("--confirm", action="store_true")
        if name in ("put", "delete"):
            c.add_argument("key")
        if name == "put":
            c.add_argument("value")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.root, merge_ops.REGISTRY.get(a.merge))
    if a.command == "scan":
        low = included(codecs.parse(a.low)) if a.low else UNBOUNDED
        high = excluded(codecs.parse(a.high)) if a.high else UNBOUNDED
        keys = KeyRange.prefix(codecs.parse(a.prefix), KeyRange(low, high)) if a.prefix else KeyRange(low, high)
        rows = store.scan(keys, a.checkpoint, limit=a.max_keys)
        if a.count:
            counted(rows).show()
        else:
            for r in rows.select(codecs.render(F.col("key"), a.keys).alias("k"), codecs.render(F.col("value"), a.values).alias("v")).toLocalIterator():
                print(r.k, r.v, sep="\t")
    elif a.command in ("manifests", "checkpoints", "files", "segments", "status", "wal"):
        getattr(inspect, {"wal": "wal_files"}.get(a.command, a.command))(store).show(1000, truncate=False)
    elif a.command in ("seq-to-ts", "ts-to-seq"):
        look = seqtime.seq_to_ts if a.command == "seq-to-ts" else seqtime.ts_to_seq
        print(look(spark.createDataFrame([(a.at,)], "probe long"), store.tracker(), "probe", not a.down, "found").first().found)
    elif a.command == "clone":
        store.clone(a.target, a.checkpoint)
    elif a.command == "compact-all":
        store.compact_all(int(time.time() * 1000))
    elif a.command == "refresh-checkpoint":
        store.refresh_checkpoint(a.name, a.lifetime_ms, int(time.time() * 1000))
    elif a.command == "checkpoint":
        print(store.create_checkpoint(a.name, a.lifetime_ms))
    elif a.command == "delete-checkpoint":
        store.delete_checkpoint(a.name)
    elif a.command == "flush":
        store.flush(int(time.time() * 1000))
    elif a.command == "compact":
        store.compact(now_ms=int(time.time() * 1000))
    elif a.command == "gc":
        print(*store.collect_garbage(a.min_age_ms, dry_run=not a.confirm), sep="\n")
    elif a.command == "destroy":
        print(*store.destroy(a.confirm), sep="\n")
    elif a.command == "put":
        print(store.put(codecs.parse(a.key), codecs.parse(a.value)))
    elif a.command == "delete":
        print(store.delete(codecs.parse(a.key)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
