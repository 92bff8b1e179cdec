"""Vectorised text kernels over Arrow string columns.

Texts stay one UTF-8 byte buffer with row offsets; words and lines are found with numpy over
the bytes and numbered by Arrow's dictionary encoder, so no kernel loops over words in Python.
Batches are cut into slices of a few megabytes, which bounds the memory of the temporaries:
only a single text larger than a slice makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts have about ``limit`` bytes."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(size[stop - 1]), stop
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def counts_between(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds between consecutive offsets."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    ``member``: the bytes of words, if others than those that are not white space. ``breaks``: further places where a word ends and another begins. ``ids``: number of each word in ``distinct``; ``bounds``: the words of text i are
    ``bounds[i]:bounds[i+1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None, member: np.ndarray | None = None):
        if lower:
            data = LOWER[data]
        inside = ~SPACE[data] if member is None else member[data]
        n = len(data)
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        edges = offsets[offsets < n] if breaks is None else np.concatenate([offsets[offsets < n], breaks])
        left = inside & ~before[:-1]
        left[edges] = inside[edges]
        starts = np.flatnonzero(left)
        after = np.empty(n + 1, dtype=bool)
        after[:-1] = inside
        after[-1] = False
        right = inside & ~after[1:]
        lasts = (offsets[(offsets > 0) & (offsets <= n)] if breaks is None else np.concatenate([offsets[(offsets > 0) & (offsets <= n)], breaks])) - 1
        right[lasts] = inside[lasts]
        ends = np.flatnonzero(right) + 1
        self.bounds = np.searchsorted(starts, offsets)
        self.starts, self.ends = starts, ends
        self.packed = data[inside]
        self.offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=self.offsets[1:])
        self._encoded: pa.DictionaryArray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def encoded(self) -> pa.DictionaryArray:
        if self._encoded is None:
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(self.packed))])
            self._encoded = words.dictionary_encode()
        return self._encoded

    @property
    def ids(self) -> np.ndarray:
        return self.encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def distinct(self) -> list[bytes]:
        return self.encoded.dictionary.to_pylist()

    @property
    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def first_of_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Mask of the first element of each run of equal keys."""
    first = np.ones(len(sorted_keys), dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return first
