"""A streaming source over a store's write batches: spark.readStream.format("palimpsest_wal").

The offset is the number of a batch that a manifest lists, so that a micro-batch always holds whole committed batches, in
order, and a batch that has been removed is an error rather than a gap. Readers open the files directly: the store must lie on a file system that every
executor mounts. For other stores use cdc.stream(), which reads through Spark.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Batch(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


class WalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root = Path(options["path"].removeprefix("file:"))
        self.first, self.most = int(options.get("after", "0")), int(options.get("maxbatches", options.get("maxBatches", "1000000000")))
        self.names = [f.name for f in schema.fields if f.name != "batch"]
        self.at = self.first

    def initialOffset(self) -> dict:
        return {"batch": self.first}

    def _manifest(self) -> dict:
        names = sorted(os.listdir(self.root / "manifest")) if (self.root / "manifest").exists() else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        return json.loads((self.root / "manifest" / names[-1]).read_text()) if names else {"next_wal": 1, "wal": []}

    def latestOffset(self) -> dict:
        self.at = min(max(self.at, self._manifest()["next_wal"] - 1), self.at + self.most)
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[Batch]:
        self.at = max(self.at, end["batch"])
        there = {w["number"]: w["path"].removeprefix("file:") for w in self._manifest()["wal"]}
        out = []
        for n in range(start["batch"] + 1, end["batch"] + 1):
            if n not in there:
                raise FileNotFoundError(f"write batch {n} has been removed")
            out.append(Batch(there[n], n))
        return out

    def read(self, partition: Batch) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for f in sorted(Path(partition.path).glob("part-*.parquet")):
            for b in pq.ParquetFile(f).iter_batches(columns=self.names):
                yield pa.RecordBatch.from_arrays([pa.array([partition.number] * b.num_rows, pa.int64()), *(b.column(c) for c in self.names)], names=["batch", *self.names])

    def commit(self, end: dict) -> None:
        pass


class WalSource(DataSource):
    """Options: path, after (number of the last batch already consumed), maxBatches (per micro-batch). A schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_wal"

    def streamReader(self, schema: StructType) -> WalReader:
        return WalReader({k.lower() if k != "path" else k: v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalSource)
