"""Settings of a store: defaults, then a JSON file, then the environment; and the folder for intermediate tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Settings:
    default_ttl_ms: int | None = None
    least_sources: int = 4
    most_sources: int = 8
    size_ratio: float = 4.0
    concurrent_compactions: int = 4
    min_age_ms: int = 86_400_000
    tracker_interval_s: int = 60
    tracker_capacity: int = 8192
    compression: str = "zstd"
    bloom_filter: bool = True
    most_unflushed: int = 1000
    most_level0: int = 256
    snapshot_lifetime_ms: int = 900_000
    max_batches_per_trigger: int | None = None

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "PALIMPSEST_", environment: dict[str, str] | None = None) -> Settings:
        values: dict[str, Any] = {}
        if path:
            with open(path) as f:
                values |= json.load(f)
        env = os.environ if environment is None else environment
        names = {f.name: f for f in fields(cls)}
        for key, text in env.items():
            name = key.removeprefix(prefix).lower()
            if key.startswith(prefix) and name in names:
                values[name] = text if name == "compression" else json.loads(text.lower())
        unknown = values.keys() - names.keys()
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def write_options(self) -> dict[str, str]:
        return {"compression": self.compression} | ({"parquet.bloom.filter.enabled#key": "true"} if self.bloom_filter else {})


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
    path = f"{root.rstrip('/')}/stores/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
