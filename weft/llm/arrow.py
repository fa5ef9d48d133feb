"""Helpers for functions that run on Arrow batches in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.storage import ship

#: Rows turned into Python objects at a time; bounds a worker's memory whatever the batch size is.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterable[pa.RecordBatch], text: int, most: int = 1 << 22, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes of column ``text``: a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; a worker gives back what a task has freed, as it waits for other stages next to the executor's heap."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it keep what they have
        ctypes.CDLL(None).malloc_trim(0)


def key_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator on texts reads, under fixed names; whatever else the table holds is pruned from the scan."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in rows sorted by them, one at a time; only the current run is held."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        tuples = list(zip(*columns, strict=True))
        start = 0
        for at in range(1, len(tuples) + 1):
            if at == len(tuples) or tuples[at] != tuples[start]:
                if tuples[start] != current:
                    if held:
                        yield current, pa.Table.from_batches(held)
                    held, current = [], tuples[start]
                held.append(batch.slice(start, at - start))
                start = at
    if held:
        yield current, pa.Table.from_batches(held)
