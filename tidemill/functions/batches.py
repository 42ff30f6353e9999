"""Arrow batches cut at the borders of groups, for kernels that work on many groups of a partition at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def starts_of(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row begins a group: its keys differ from those of the row before."""
    first = np.zeros(batch.num_rows, dtype=bool)
    if batch.num_rows:
        first[0] = True
    for key in keys:
        codes = batch.column(key).combine_chunks()
        if pa.types.is_string(codes.type) or pa.types.is_large_string(codes.type):
            codes = codes.dictionary_encode().indices
        values = codes.to_numpy(zero_copy_only=False)
        first[1:] |= values[1:] != values[:-1]
    return first


def whole_groups(
    keys: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.RecordBatch | pa.Table], rows: int = 200_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over partitions sorted by ``keys``. The kernel gets tables of whole groups, of
    about ``rows`` rows (more only where one group has more), and the mask of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = kernel(table, starts_of(table, keys))
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            first = starts_of(table, keys)
            cut = int(np.flatnonzero(first)[-1])
            if cut:
                yield from emit(table.slice(0, cut))
            rest = table.slice(cut)
            held, count = rest.to_batches(), rest.num_rows
            # a group longer than the limit: wait until as much again has come, so that it isn't joined up per batch
            rows_now = max(rows, 2 * count)
            if count > rows // 2:
                for batch in batches:
                    held.append(batch)
                    count += batch.num_rows
                    if count >= rows_now:
                        break
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def overlapping(
    keys: list[str], kernel: Callable[[pa.Table, np.ndarray, slice], pa.RecordBatch | pa.Table], halo: int, rows: int = 200_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over partitions sorted by ``keys``, for kernels that look at most ``halo`` rows around
    each. The kernel gets tables of about ``rows`` rows, however long a group is, the mask of first rows of groups and the
    slice of rows to give out: those before and after it are given out with another table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = known = 0  # rows held, and those of them that were given out before

        def emit(table: pa.Table, upto: int) -> Iterator[pa.RecordBatch]:
            out = kernel(table, starts_of(table, keys), slice(known, upto))
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= rows + 2 * halo:
                table = pa.Table.from_batches(held)
                yield from emit(table, count - halo)
                rest = table.slice(max(0, count - 2 * halo))
                known = rest.num_rows - halo
                held, count = rest.to_batches(), rest.num_rows
        if count > known:
            yield from emit(pa.Table.from_batches(held), count)

    return run
