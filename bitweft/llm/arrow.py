"""Row-wise operators over Arrow batches: bounded memory, rows stay with their ids."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once in a Python worker.
SLICE_BYTES = 4 << 20


def release() -> None:
    """Gives free memory back to the system: a worker is used again, and what it keeps adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about SLICE_BYTES in `column` each (one row at least)."""
    col = batch.column(column)
    size, rows = max(col.nbytes, 1), batch.num_rows
    step = max(1, int(rows * SLICE_BYTES / size))
    if step >= rows:
        yield batch
        return
    at = 0
    while at < rows:
        n = step
        while n > 1 and batch.slice(at, n).column(column).nbytes > 2 * SLICE_BYTES:  # a few very long texts side by side
            n = max(1, n // 2)
        yield batch.slice(at, n)
        at += n


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    col = batch.column(column)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def map_rows(df: DataFrame, schema: str, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with `make()` run once a task; its function turns each slice of a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = batch = part = None
        for batch in batches:
            f = f or make()
            for part in slices(batch, text):
                if part.num_rows:
                    yield f(part)
        del f, batch, part
        release()

    return df.mapInArrow(run, schema)
