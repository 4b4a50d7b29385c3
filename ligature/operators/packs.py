"""Packed pieces of Arrow batches as arrays, those of one length together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers in the tables of the pieces that a kernel takes at once.
CELLS = 2_000_000


TYPES = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


def arrow_schema(columns: str) -> pa.Schema:
    """The Arrow schema of columns as mapInArrow takes them, `name type, ...`; tasks have no session to ask."""
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of lists; null is an empty list."""
    return numbers(column.flatten()), np.nan_to_num(numbers(column.value_lengths())).astype(np.int64)


def places(column: pa.Array, n: int) -> np.ndarray:
    """[row, place]: which of the places 0..n - 1 a column of lists of places names."""
    values, sizes = lists(column)
    out = np.zeros((len(sizes), n), bool)
    out[np.repeat(np.arange(len(sizes)), sizes), values.astype(np.int64)] = True
    return out


def table(column: pa.Array) -> np.ndarray:
    """[row, part] of a column of lists of one length."""
    return numbers(column.flatten()).astype(float).reshape(len(column), -1)


def padded(column: pa.Array) -> np.ndarray:
    """[row, place] of a column of lists of numbers, with infinity after the end of each."""
    values, sizes = lists(column)
    out = np.full((len(sizes), sizes.max(initial=0)), np.inf)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def by_length(leaves: pa.Array, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors [row, leaf, part], edges [row, leaf + 1]) of packed leaves (leaf, start, end, vec).

    Pieces come in groups of one number n of leaves, of so many that their tables of (n + 1)**2 have about `cells` numbers.
    """
    flat, sizes = leaves.flatten(), numbers(leaves.value_lengths()).astype(np.int64)
    start, end, vec = numbers(flat.field("start")), numbers(flat.field("end")), flat.field("vec")
    vectors = numbers(vec.flatten()).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    first = sizes.cumsum() - sizes
    for n in np.unique(sizes[sizes > 0]).tolist():
        all_rows, step = np.flatnonzero(sizes == n), max(1, cells // (n + 1) ** 2)
        for at in range(0, len(all_rows), step):
            rows = all_rows[at : at + step]
            own = first[rows][:, None] + np.arange(n)
            yield rows, vectors[own], np.concatenate([start[own], end[own[:, -1:]]], axis=1)
