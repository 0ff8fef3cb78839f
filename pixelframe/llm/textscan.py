"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

A *word* here is a maximal run of ASCII letters and non-ASCII bytes.  All
functions work on plain NumPy arrays so that a task handles millions of
characters with a few array operations and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; bounds the memory of a task.
SLICE_BYTES = 600_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``limit`` bytes of ``text``.

    A single longer text is a piece of its own; no text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of some texts: ``start``/``end`` byte positions, ``doc`` index, ``per_doc`` counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        # A separator after every text keeps words inside their documents.
        padded = np.zeros(len(data) + self.n_docs + 2, np.uint8)
        shift = np.repeat(np.arange(self.n_docs), np.diff(offsets))
        padded[np.arange(len(data)) + shift + 1] = _LOWER[data]
        self.bytes = padded
        self.text_start = offsets[:-1] + np.arange(self.n_docs) + 1
        inside = _LETTER[padded]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def distinct(self) -> tuple[Words, np.ndarray, np.ndarray]:
        """(one example of each distinct word, its hashes, index of every word among them)."""
        hashes, example, inverse = np.unique(self.hashes(), return_index=True, return_inverse=True)
        out = object.__new__(Words)
        out.bytes, out.start, out.end = self.bytes, self.start[example], self.end[example]
        return out, hashes, inverse

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte positions of all words one after another, first index of each word)."""
        size = self.end - self.start
        first = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.start - first, size), first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its byte values, finalised."""
        if not len(self):
            return np.zeros(0, np.uint64)
        at, first = self.letters()
        within = at - np.repeat(self.start, self.end - self.start)
        power = np.ones(int(within.max()) + 1, np.uint64)
        power[1:] = _MULT
        power = np.multiply.accumulate(power)
        return mix64(np.add.reduceat(_BYTE_VALUE[self.bytes[at]] * power[within], first))
