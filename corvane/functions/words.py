"""Words of Arrow text columns, found in whole batches: numpy marks their borders, and a batch's distinct words are looked at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: bytes of text that are held as words at once; one text is never split
SLICE_BYTES = 8 << 20


def _class(extra: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c for c in range(128) if chr(c).isalnum() or chr(c) in extra]] = True
    return out


_PLAIN, _UNDERSCORE = _class(""), _class("_")


def slices(batch: pa.RecordBatch, column: int):
    """A batch in pieces of about SLICE_BYTES of the column's text or lists."""
    c = batch.column(column)
    if not len(c):
        return
    sizes = pa.compute.binary_length(c) if pa.types.is_string(c.type) else pa.compute.multiply(pa.compute.list_value_length(c), 32)
    at = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    ends = [*(np.flatnonzero(np.diff(at)) + 1).tolist(), len(c)]
    for lo, hi in zip([0, *ends], ends):
        yield batch.slice(lo, hi - lo)


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def of_text(texts: pa.Array, underscore: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word, words): for each run of ASCII letters and digits (and _), in order, its row and its place among the distinct words."""
    n = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.fill_null("")), "")[0].as_buffer() if len(texts) else pa.py_buffer(b"")
    raw = np.frombuffer(flat, np.uint8)
    inside = (_UNDERSCORE if underscore else _PLAIN)[raw]
    starts = np.cumsum(n) - n  # of rows
    begins, over = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    over[:-1] &= ~inside[1:]
    edge = starts[(n > 0) & (starts > 0)]  # words end with their row
    begins[edge] = inside[edge]
    over[edge - 1] = inside[edge - 1]
    b, e = np.flatnonzero(begins), np.flatnonzero(over) + 1
    offsets = np.zeros(len(b) + 1, np.int32)
    np.cumsum(e - b, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(b), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
    return np.searchsorted(np.cumsum(n), b, side="right"), *_encoded(words)


def of_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same of lists of words."""
    n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    keep = flat.is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n)[keep], *_encoded(flat.drop_null())


def counted(row: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count, index of the first) of distinct pairs, by row."""
    key = row * width + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    first = order[at]
    return row[first], word[first], np.diff(np.append(at, len(key))), first


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, .. for each i, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
