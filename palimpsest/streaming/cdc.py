"""Change data capture: batches of a store in order, as a cursor or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.log import LogError
from ..sources.store import Store


class Truncated(LogError):
    """Batches after the cursor are gone."""


def batches(store: Store, cursor: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """(number, rows) of every write batch after the cursor. A batch is whole: all rows of its sequence numbers."""
    m = store.manifest()
    there = {w["number"]: w["path"] for w in m.wal}
    for n in range(cursor + 1, m.next_wal):
        if n not in there:
            raise Truncated(f"write batch {n} has been removed")
        yield n, store.wal.read(store.spark, store.schema, [there[n]]).orderBy("seq", "key")


def consume(store: Store, sink: Callable[[DataFrame, int], Any], cursor: int = 0) -> int:
    """Hands each batch to a sink and returns the new cursor. At least once: a sink must bear a batch twice."""
    for n, rows in batches(store, cursor):
        sink(rows, n)
        cursor = n
    return cursor


def stream(spark: Any, folder: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet batches as an unbounded table, with the number of the batch. max_files bounds a micro-batch.

    For folders that other tools fill: every finished folder counts, and the files of a batch may come in several
    micro-batches. A store's own batches are followed by follow(), whole and committed only.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    rows = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/(\d{20})[^/]*/", 1).cast("long"))


def follow(store: Store, after: int = 0) -> DataFrame:
    """The committed batches of a store as an unbounded table, whole and in order (streaming/source.py)."""
    from . import source

    source.register(store.spark)
    kind = T.StructType([T.StructField("batch", T.LongType()), *[T.StructField(f.name, f.dataType) for f in store.schema]])
    reader = store.spark.readStream.format("palimpsest_wal").schema(kind).option("path", store.root).option("after", str(after))
    most = store.settings.max_batches_per_trigger
    return (reader if most is None else reader.option("maxBatches", str(most))).load()


def materialize_latest(rows: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> Any:
    """Writes each micro-batch under its number: repeating one overwrites its own folder, so the sink is idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{number:020d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_state(rows: DataFrame, merge: Callable[[Any, Any], Any], value: T.DataType) -> DataFrame:
    """key, value, seq of each key after every micro-batch: operands are folded into the state, values replace it, tombstones clear it."""
    name = value.simpleString()
    key = rows.schema["key"].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, last = state.get if state.exists else (None, -1)
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.seq <= last:
                continue
            if row.kind == "M":
                current = row.value if current is None else merge(current, row.value)
            else:
                current = row.value if row.kind == "V" else None
            last = row.seq
        if current is not None and current == current:
            state.update((current, last))
            yield pd.DataFrame({"key": [k[0]], "value": [current], "seq": [last]})
        else:
            state.update((None, last))

    return rows.groupBy("key").applyInPandasWithState(step, f"key {key}, value {name}, seq long", f"value {name}, seq long", "update", GroupStateTimeout.NoTimeout)
