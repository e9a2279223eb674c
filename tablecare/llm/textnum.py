"""Words, 64-bit word hashes and shingles of whole Arrow text columns, computed in numpy.

Everything works on the UTF-8 bytes of a column, a bounded number of bytes at a time. Null
texts count as empty. Two words are taken as equal when their 64-bit hashes are; the chance
that any two of ``n`` distinct words clash is about ``n**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are spread out in numpy arrays at a time (one longer text is taken alone).
CHUNK_BYTES = 2 * 1024 * 1024
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_table(lower: bool = True, blank: str = "") -> np.ndarray:
    """A map of bytes: A-Z lower-cased if asked, the bytes of ``blank`` turned into spaces."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(blank.encode())] = 32
    return table


LOWER = byte_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array without copying."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """The words of rows ``lo`` to ``hi`` of a column.

    ``hash`` holds one value per word, ``first[i] : first[i + 1]`` are the words of row ``i``.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lo: int, hi: int, table: np.ndarray, runs=None):
        base, end = int(offsets[lo]), int(offsets[hi])
        size = end - base
        buf = np.zeros(size + 8, np.uint8)
        buf[:size] = table[data[base:end]]
        self.rows = hi - lo
        self.row_start = offsets[lo : hi + 1] - base
        edge = np.zeros(size + 1, bool)
        edge[self.row_start] = True
        if runs is None:
            kind = (~SPACE[buf[:size]]).astype(np.uint8)
        else:
            kind = runs[buf[:size]]
        change = edge[:size].copy()
        change[1:] |= kind[1:] != kind[:-1]
        cuts = np.flatnonzero(change)
        starts = cuts[kind[cuts] > 0]
        stops = np.append(cuts[1:], size)[kind[cuts] > 0] if len(cuts) else cuts
        self.starts, self.lengths = starts, stops - starts
        self.bytes, self.size, self.kind = buf, size, kind
        self.first = np.searchsorted(starts, self.row_start)
        self.hash = self._hashed()

    def _hashed(self) -> np.ndarray:
        window = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        value = mix(self.lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        left, at = self.lengths, np.arange(len(self.starts))
        k = 0
        while len(at):
            part = window[self.starts[at] + k] & _MASK[np.minimum(left, 8)]
            value[at] = mix(value[at] ^ part) + part
            k += 8
            keep = left > 8
            at, left = at[keep], left[keep] - 8
        return value

    def shingles(self, n: int) -> Iterator[np.ndarray]:
        """Per row the sorted distinct hashes of its word ``n``-grams.

        A row of fewer than ``n`` words gives its whole word sequence as one value, a row
        without words gives none.
        """
        h = self.hash
        rolled = np.full(max(0, len(h) - n + 1), np.uint64(n))
        for k in range(n):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)])
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= n:
                yield np.unique(rolled[a : b - n + 1])
            elif b > a:
                short = np.full(1, np.uint64(b - a))
                for k in range(a, b):
                    short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def hashed_words(words: list[str], table: np.ndarray = LOWER) -> np.ndarray:
    """The hash of each single word, as ``Words`` gives it inside a text."""
    offsets, data = raw(pa.array(words, pa.large_string()))
    return Words(offsets, data, 0, len(words), table).hash


def each_chunk(
    batches, text: str, table: np.ndarray = LOWER, runs=None, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches, of at most ``limit`` bytes of text or one row, with the words of their texts."""
    for batch in batches:
        offsets, data = raw(text_column(batch, text))
        for lo, hi in ranges(offsets, limit):
            yield batch.slice(lo, hi - lo), Words(offsets, data, lo, hi, table, runs)
