"""Whole-batch word segmentation and hashing on Arrow string buffers.

Every Python operator of this package reads texts through here, so that a word
means the same everywhere: a maximal run of bytes other than space and tab to
carriage return, with A-Z lower-cased.  No Python string is made per word: the
work is numpy over the UTF-8 bytes of a few documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64, endpoint=False)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, CHUNK_BYTES + 1)
        held = np.full(size, base, dtype=U64)
        held[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(held, out=held)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of consecutive documents. first[d]:first[d+1] are the words of document d."""

    data: np.ndarray  # lower-cased bytes
    raw: np.ndarray  # bytes as they are
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    sums: np.ndarray  # prefix sums behind the hashes

    def prefix_hash(self, n: int | None = None, skip: int = 0) -> np.ndarray:
        """64-bit hash of each whole word, or of its first n bytes, from byte skip on."""
        s = np.minimum(self.starts + skip, self.ends) if skip else self.starts
        e = self.ends if n is None else np.minimum(self.starts + n, self.ends)
        h = (self.sums[e] - self.sums[s]) * power(INVERSE, len(self.data) + 1)[s]
        return mix(h + (e - s).astype(U64))

    def suffix_hash(self, n: int) -> np.ndarray:
        s = np.maximum(self.ends - n, self.starts)
        h = (self.sums[self.ends] - self.sums[s]) * power(INVERSE, len(self.data) + 1)[s]
        return mix(h + (self.ends - s).astype(U64))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of a few whole texts each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def segment(raw: np.ndarray, offsets: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    data = LOWER[raw]
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    sums = np.zeros(len(raw) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power(BASE, len(raw)), out=sums[1:])
    return Words(data, raw, starts, ends, doc, first, sums)


def string_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())
