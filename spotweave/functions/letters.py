"""Texts and lists of an Arrow batch as flat arrays, for steps letter by letter that expressions would take one at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters as code points, edges of rows) of texts; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, "<i8" if pa.types.is_large_string(column.type) else "<i4")[column.offset :][: len(column) + 1].astype(np.int64)
    octets = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    if not len(octets) or int(octets.max()) <= 0x7F:
        return octets, edges - edges[0]
    wide = np.frombuffer(octets.tobytes().decode().encode("utf-32-le"), "<u4")
    return wide, np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges of rows) of lists of whole numbers; null lists are empty, null values 0."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.int64())
    return (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])


def text(letters: np.ndarray, size: np.ndarray, absent: np.ndarray) -> pa.Array:
    """Texts of so many code points each; absent ones are null."""
    edges = np.concatenate([[0], np.cumsum(size)])
    if len(letters) and int(letters.max()) > 0x7F:
        whole = letters.astype("<u4").tobytes().decode("utf-32-le")
        return pa.array([None if no else whole[a:z] for a, z, no in zip(edges, edges[1:], absent, strict=False)], pa.string())
    bits = pa.py_buffer(np.packbits(~absent, bitorder="little")) if absent.any() else None
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(letters.astype(np.uint8)), bits)
