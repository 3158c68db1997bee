"""Slices of Arrow batches that hold a bounded number of text bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A slice holds so many bytes of text, or one longer text.
BLOCK_BYTES = 2_000_000


#: Bytes of an Arrow batch of texts on its way to a worker, where the session says nothing.
BATCH_BYTES, BATCH_SETTING = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text (null as empty) and further columns of docs.

    Rows travel to Python in batches of 10,000 by default, which long texts would fill with any number of bytes. So the session's
    limit in bytes is set, unless it has one.
    """
    if BATCH_SETTING not in docs.sparkSession.conf.getAll:
        docs.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def blocks(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts each batch so that working arrays stay small whatever the batch size; no row is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = offsets(batch.column(column))
        ends, start, base = found[1:], 0, int(found[0])
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    settle()


def settle() -> None:
    """Gives free memory back, so that a worker that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column, one more than its rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows together, and the rows' offsets in them."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows with equal first columns, from batches in which these are neighbours."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:]):
            if held and keys[a] != key:
                yield whole(held)
                held = []
            held.append(b.slice(a, z - a))
            key = keys[a]
    if held:
        yield whole(held)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield whole(held)
            held, n = [], 0
    if held:
        yield whole(held)
    held = []
    settle()


def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of several."""
    if len(batches) == 1:
        return batches[0]
    joined = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in joined.columns], joined.schema.names)
