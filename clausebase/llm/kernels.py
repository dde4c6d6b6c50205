"""Array code for the Python-side operators: whole Arrow columns of UTF-8 text, no loops over characters.

Texts are handled as bytes.  A slice is a run of whole texts of about
``SLICE_BYTES``, so the working memory of a task is bounded by that or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: Byte classes: letters and digits (and any byte of a non-ASCII character) make words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Slice(NamedTuple):
    """Texts ``first`` to ``last`` of a batch: their bytes, and where each begins and ends."""

    first: int
    last: int
    data: np.ndarray
    ends: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column (null: empty) into slices of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(ends, ends[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield Slice(i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        step = np.full(size, _BASE if kind == "up" else _INVERSE, U)
        step[0] = 1
        _powers[kind] = have = np.multiply.accumulate(step)
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, for ``span_hash``."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; they depend on the bytes of a span alone."""
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(U))


def runs(flags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags that don't cross texts: start, end, and the number of runs before each text's end."""
    cut = np.zeros(len(flags) + 1, bool)
    cut[ends] = True
    on = np.concatenate(([False], flags, [False]))
    starts = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    stops = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ASCII-lower-cased words, starts, stops, and each text's bounds among them."""
    low = LOWER[part.data]
    starts, stops, bounds = runs(WORD[low], part.ends)
    return span_hash(prefix(low), starts, stops), starts, stops, bounds


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row; one for all words of a shorter text; none for no words."""
    if len(word) == 0:
        return word
    width = min(width, len(word))
    out = np.zeros(len(word) - width + 1, U)
    for k in range(width):
        out = out * U(0x9FB21C651E98DF25) + word[k : len(word) - width + 1 + k]
    return mix(out)
