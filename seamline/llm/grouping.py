"""Groups in a stream of Arrow batches whose rows are sorted by the group's columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns as lists) of each run of equal keys; only one group is held at a time."""
    group, rows = None, {}
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in batch.schema.names}
        if not batch.num_rows:
            continue
        each = list(zip(*(columns[k] for k in keys)))
        at = 0
        while at < len(each):
            end = at
            while end < len(each) and each[end] == each[at]:
                end += 1
            if each[at] != group:
                if group is not None:
                    yield group, rows
                group, rows = each[at], {k: [] for k in columns}
            for k, v in columns.items():
                rows[k].extend(v[at:end])
            at = end
    if group is not None:
        yield group, rows


def roots(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the smallest name that the links (i, j) reach."""
    root = names.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            return root


def vectors_of(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Dimension (-1: unusable) and double-precision values of each vector of a list column.

    Unusable are vectors that are null, empty, zero, or have a null or non-finite component.
    """
    rows: list[np.ndarray | None] = []
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)  # null: NaN
    lengths = [0 if v is None else v for v in pa.compute.list_value_length(column).to_pylist()]
    at = 0
    for n in lengths:
        v = values[at: at + n]
        at += n
        rows.append(v if n and np.isfinite(v).all() and v.any() else None)
    return np.array([-1 if v is None else len(v) for v in rows], dtype=np.int64), rows
