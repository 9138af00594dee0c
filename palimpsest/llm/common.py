"""What the operators of this folder share: folds, a shared place for intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"


def fold(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has no fold (null)."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def is_fold(id_col: Column | str, modulus: int, remainder: int) -> Column:
    """Whether a row lies in this fold; false for a null id."""
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False))


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local master gets a temporary folder; a cluster gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/palimpsest/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors.

    Results may be read for as long as the driver lives; when it ends, its file system client removes the table.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_values(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    if pa.types.is_string(array.type):
        array = array.cast(pa.binary())
    elif pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    return [b"" if x is None else x for x in array.to_pylist()]


def packed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a 2-d uint8 array, one value of equal width per row."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def rows_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each non-empty batch with the bytes of its text column."""
    for batch in batches:
        if batch.num_rows:
            yield batch, binary_values(batch.column(text))
