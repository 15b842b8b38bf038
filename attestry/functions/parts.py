"""Arrow functions that hold the Python objects of a few rows at a time, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of input that are Python objects at a time, and rows at most.
PART_BYTES, PART_ROWS = 1 << 20, 1024


def parts(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and end of ranges of rows that hold ``PART_BYTES`` at most, or are one row."""
    at, n = 0, len(columns[0])
    while at < n:
        rows = min(PART_ROWS, n - at)
        while rows > 1 and sum(c.slice(at, rows).nbytes for c in columns) > PART_BYTES:
            rows //= 2
        yield at, at + rows
        at += rows


def in_parts(run: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``run`` over lists of the columns' values, by parts, as one array."""
    done = [run(*(c.slice(a, b - a).to_pylist() for c in columns)).cast(kind) for a, b in parts(*columns)]
    return pa.concat_arrays(done) if done else pa.array([], kind)
