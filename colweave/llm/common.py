"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.scratch import fresh_dir


def written(df: DataFrame, label: str, row_group_bytes: int = 16 << 20) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, readable after executors are lost.

    Row groups are small, as a task holds the one it writes in memory.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.option("parquet.block.size", row_group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def unit_hash(*columns: Column | str) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.shiftright(F.xxhash64(*columns), 11), F.lit(1 << 53)).cast("double") / float(1 << 53)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least, so that long texts do not pile up.

    Where rows carry their text inside the struct ``row`` only, it is given a column of its own.
    """
    for batch in batches:
        if text not in batch.schema.names:
            carried = batch.column("row")
            batch = pa.RecordBatch.from_arrays([carried, carried.field(text)], names=["row", text])
        lengths = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last, freed memory goes back to the system.

    A Python worker outlives its task, and what its allocators keep for it adds to what the executor's other workers need.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)


def list_array(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
