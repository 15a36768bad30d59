"""Texts in Arrow batches, for the few steps that need more than column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def groups(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows whose texts add up to about ``most`` bytes, at least one row each, and their texts (null: empty)."""
    column = batch.column(text)
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and size + n > most:
            yield batch.slice(start, i - start), pc.fill_null(column.slice(start, i - start), "").to_pylist()
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start), pc.fill_null(column.slice(start), "").to_pylist()
