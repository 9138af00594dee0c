"""Filters that rule out whole files before they are read.

A policy makes one sketch per file when the file is written; the sketches lie beside the manifests, and a point or prefix
read asks all of them on the driver. A file is read only if every sketch lets it through. There are no false negatives.
"""

from __future__ import annotations

import base64
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import DelimitedPrefix, FixedPrefix
from ..functions.ranges import KeyRange


class FilterPolicy(Protocol):
    name: str

    def build(self, rows: DataFrame) -> str: ...

    def may_hold(self, sketch: str, keys: KeyRange, spark: Any) -> bool: ...


class BoundsPolicy:
    """Least and greatest key."""

    name = "bounds"

    def build(self, rows: DataFrame) -> str:
        r = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        return repr((bytes(r.lo), bytes(r.hi)) if isinstance(r.lo, (bytes, bytearray)) else (r.lo, r.hi))

    def may_hold(self, sketch: str, keys: KeyRange, spark: Any) -> bool:
        from ast import literal_eval

        from ..functions.ranges import included

        lo, hi = literal_eval(sketch)
        return lo is not None and keys.overlaps(KeyRange(included(lo), included(hi)))


class BloomPolicy:
    """A Bloom filter of the hashes of whole keys, or of their prefixes; built by Spark in one aggregation."""

    def __init__(self, prefix: FixedPrefix | DelimitedPrefix | None = None, expected: int = 1_000_000, error: float = 0.01) -> None:
        self.prefix, self.expected, self.error = prefix, expected, error
        self.name = "bloom" if prefix is None else f"bloom:{prefix.name}"
        self.asked: tuple[Any, int] | None = None  # the last key and its hash: a read asks every file for the same one

    def build(self, rows: DataFrame) -> str:
        part = F.col("key") if self.prefix is None else self.prefix.column(F.col("key"))
        hashed = rows.select(part.alias("k")).where("k is not null").select(F.xxhash64("k").alias("h"))
        bloom = hashed._jdf.stat().bloomFilter("h", self.expected, self.error)
        out = rows.sparkSession._jvm.java.io.ByteArrayOutputStream()
        bloom.writeTo(out)
        return base64.b64encode(bytes(out.toByteArray())).decode()

    def may_hold(self, sketch: str, keys: KeyRange, spark: Any) -> bool:
        point = keys.as_point()
        wanted = point if self.prefix is None else self.prefix.of(point) if point is not None else self.prefix.shared(keys)
        if wanted is None:
            return True
        if self.asked is None or self.asked[0] != wanted:
            self.asked = (wanted, spark.range(1).select(F.xxhash64(F.lit(wanted))).first()[0])
        h = self.asked[1]
        raw = bytearray(base64.b64decode(sketch))
        stream = spark._jvm.java.io.ByteArrayInputStream(raw)
        return bool(spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(stream).mightContainLong(h))
