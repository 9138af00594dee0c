"""Sequence numbers and timestamps: the sampled tracker and its as-of lookups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .log import LogError

INTERVAL_S, CAPACITY = 60, 8192


def sample(points: Iterable[tuple[int, int]], interval_s: int = INTERVAL_S, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(seq, seconds) kept of points in order: at least an interval apart; beyond the capacity every second one goes."""
    kept: list[tuple[int, int]] = []
    for seq, ts in points:
        if kept and ts - last < interval_s:
            continue
        if kept and (seq < kept[-1][0] or ts < kept[-1][1]):
            raise ValueError("sequence numbers and timestamps must not fall")
        kept.append((seq, ts))
        last = ts
        if len(kept) > capacity:
            kept = kept[::2]
    return kept


def build_tracker(log: DataFrame, interval_s: int = INTERVAL_S, capacity: int = CAPACITY) -> DataFrame:
    """seq, ts (seconds) of a log with create_ts in milliseconds.

    The greedy choice depends on all earlier ones, but only the first row of a second can be chosen. Rows are therefore
    reduced to the first sequence number of each second, and then to the distinct seconds that are streamed in order
    to the driver, which keeps at most `capacity` of them.
    """
    seconds = log.where("create_ts is not null").groupBy(F.floor(F.col("create_ts") / 1000).cast("long").alias("ts")).agg(F.min("seq").alias("seq")).orderBy("ts")
    kept = sample(((r.seq, r.ts) for r in seconds.toLocalIterator(prefetchPartitions=True)), interval_s, capacity)
    return log.sparkSession.createDataFrame(kept, "seq long, ts long")


def _as_of(probes: DataFrame, tracker: DataFrame, probe: str, by: str, give: str, up: bool, out: str, capacity: int = CAPACITY) -> DataFrame:
    kept = [r for r in tracker.select(by, give).limit(capacity + 1).collect() if r[0] is not None]
    if len(kept) > capacity:
        raise LogError(f"a tracker holds at most {capacity} samples: thin it with build_tracker()")
    samples: dict[int, int] = {}
    for at, value in sorted(kept, key=lambda r: (r[0], r[1]), reverse=up):
        samples[at] = value  # of equal samples the first one upwards, the last one downwards
    keys = np.array(sorted(samples), np.int64)
    values = np.array([samples[k] for k in keys.tolist()], np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(0)
            x = asked.fill_null(0).to_numpy(zero_copy_only=False)
            place = np.searchsorted(keys, x, "left") if up else np.searchsorted(keys, x, "right") - 1
            none = (place < 0) | (place >= len(keys)) | asked.is_null().to_numpy(zero_copy_only=False)
            found = values[np.clip(place, 0, max(len(keys) - 1, 0))] if len(keys) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([asked, pa.array(found, pa.int64(), mask=none)], names=[probe, out])

    return probes.select(F.col(probe).cast("long").alias(probe)).distinct().mapInArrow(look, StructType([StructField(probe, LongType()), StructField(out, LongType())]))


def seq_to_ts(probes: DataFrame, tracker: DataFrame, probe: str = "seq", up: bool = True, out: str = "ts") -> DataFrame:
    """Timestamp of each distinct probe: of the next sample at or after it (up) or the last at or before it (down); null beyond the ends."""
    return _as_of(probes, tracker, probe, "seq", "ts", up, out)


def ts_to_seq(probes: DataFrame, tracker: DataFrame, probe: str = "ts", up: bool = True, out: str = "seq") -> DataFrame:
    return _as_of(probes, tracker, probe, "ts", "seq", up, out)
