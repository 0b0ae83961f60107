"""Words of many texts at once: bounds and 64-bit hashes, found on the bytes of an Arrow column with numpy.

A word is a run of bytes outside a set of ASCII separators, so that UTF-8 needs no decoding. Its hash is the sum of
byte values weighted by position (a multilinear hash), mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and digits.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit hangs on all input bits (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        x = x + ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_weights = mix(np.arange(1000, 5096, dtype=np.uint64)) | np.uint64(1)


def _weight(n: int) -> np.ndarray:
    """Weights of the first n places of a word; those of longer words aren't kept."""
    return _weights if n <= len(_weights) else mix(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1)


class Run(NamedTuple):
    """Texts first to last (exclusive) of a column; words[at[i] : at[i + 1]] are those of text first + i."""

    first: int
    last: int
    data: np.ndarray  # bytes of all texts, lower-cased
    raw: np.ndarray  # bytes as they are
    texts: np.ndarray  # where each text begins in data, and the end
    at: np.ndarray
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    words: np.ndarray  # hashes
    prefixes: dict[int, np.ndarray]  # hashes of the words' first bytes


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at


def runs(column: pa.Array, separators: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> Iterator[Run]:
    """The words of a column's texts, in runs of RUN_BYTES."""
    whole, offsets = column_bytes(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        last = min(last, n)
        yield _run(whole, offsets, first, last, separators, prefixes)
        first = last


def _run(whole: np.ndarray, offsets: np.ndarray, first: int, last: int, separators: np.ndarray, prefixes: tuple[int, ...]) -> Run:
    raw = whole[offsets[first] : offsets[last]]
    texts = offsets[first : last + 1] - offsets[first]
    data, inside = LOWER[raw], ~separators[raw]
    size = len(raw)
    edge = np.zeros(size + 1, dtype=bool)
    edge[texts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    lengths = ends - starts
    places = np.flatnonzero(inside)
    nth = places - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        value = BYTES[data[places]] * _weight(int(lengths.max()) if len(lengths) else 0)[nth]
        bounds = np.cumsum(lengths) - lengths
        words = mix(np.add.reduceat(value, bounds) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)
        short = {}
        for p in prefixes:
            short[p] = mix(np.add.reduceat(np.where(nth < p, value, np.uint64(0)), bounds) + np.uint64(p << 32)) if len(starts) else words
    return Run(first, last, data, raw, texts, np.searchsorted(starts, texts), starts, ends, words, short)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; fewer words are one gram, none give none."""
    m = min(n, len(words))
    if m == 0:
        return words
    with np.errstate(over="ignore"):
        out = np.full(len(words) - m + 1, np.uint64(m))
        for i in range(m):
            out = out * ODD + words[i : len(words) - m + 1 + i]
    return mix(out)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of mask from each bound to the next."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
