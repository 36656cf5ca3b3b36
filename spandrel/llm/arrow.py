"""Small helpers for functions that run in Python workers over Arrow batches.

A batch may hold many thousand rows, so rows become Python objects a slice at a
time, and a worker gives freed memory back when its task ends: idle workers stay
beside the executor's heap.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def frugal(run: Callable) -> Callable:
    """``run`` over batches, giving memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], ddl: str | StructType, flush: int = 4096) -> DataFrame:
    """Apply a row function in Arrow batches.

    ``make()`` runs once a task and returns a function from a row (dict) to
    output tuples in the order of ``ddl``. Output goes out every ``flush`` rows.
    """
    target = to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held = make(), []
        names = target.names
        for batch in slices(batches):
            keys = batch.schema.names
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                held.extend(work(dict(zip(keys, values))))
                if len(held) >= flush:
                    yield to_batch(held, target, names)
                    held = []
        if held:
            yield to_batch(held, target, names)

    return df.mapInArrow(frugal(run), ddl)


def to_batch(rows: list[tuple], target: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[i], type=target.field(i).type) for i in range(len(names))], schema=target)
