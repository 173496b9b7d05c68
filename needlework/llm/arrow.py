"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = np.nan_to_num(data_lengths(data))
        group = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def data_lengths(values: pa.Array) -> np.ndarray:
    """Byte lengths; nulls count zero."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def lower_texts(values: pa.Array) -> pa.Array:
    """Whole texts with A-Z lower-cased; null counts as empty.

    Taken row by row first, as the Arrow function misreads the offsets of a slice.
    """
    import pyarrow.compute as pc

    rows = pc.fill_null(values.cast(pa.large_string()), "").take(pa.array(np.arange(len(values))))
    return pc.ascii_lower(rows)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
