"""Helpers that the operators share: whole texts as numpy bytes, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..tables import written

__all__ = ["lower", "mix", "powers", "prefix_hash", "span_hash", "text_blocks", "words", "written"]

#: Odd base of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts have about `most` bytes (a longer text comes alone): rows, bytes, row offsets. A null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        if not len(texts):
            continue
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), all_bytes[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums p with p[j] - p[i] the polynomial hash of data[i:j], still times BASE**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0] if len(data) else data.astype(np.uint64), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that don't depend on where a span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a hash serve alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def words(data: np.ndarray, at: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of `solid` bytes or else `[^\\x20\\x09-\\x0D]+`; none crosses from a row to the next."""
    if solid is None:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin = at[:-1][at[:-1] < at[1:]]
    first[begin] |= solid[begin]
    end = at[1:][at[:-1] < at[1:]] - 1
    last[end] |= solid[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
