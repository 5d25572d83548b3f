"""Tables in the shared folder, and how documents are dealt into blocks.

A block is a run of rows of one input partition, of about BLOCK_BYTES of text, kept as one row. Written once to
the shared folder, blocks have a fixed content, so that later jobs can answer a block by its id.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kmerloom.session import shared, ship

BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, with the package shipped to the executors that will work on it."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and return the table read back: no lineage, safe against lost executors."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as large_string, nulls as empty texts."""
    return pc.fill_null(column(batch, name).cast(pa.large_string()), "")


def text_offsets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array without nulls, and each text's byte offsets."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def tidy() -> None:
    """Give memory that a task no longer holds back to the system, as a worker that waits for its next task shares its executor's limit."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `most` bytes of text each (a longer text makes a run alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
    tidy()


def block_ids() -> Iterator[int]:
    """Ids of the blocks of the task's partition."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 32
    while True:
        yield base
        base += 1


def arrow(schema_ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema_ddl))


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = BLOCK_BYTES, name: str = "text") -> Callable:
    """fn over runs of rows, as a function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most, name):
            yield fn(part)

    return run
