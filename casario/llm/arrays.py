"""Numpy helpers for text columns inside tasks: bytes, chunks, words, hashes.

Everything here works on one bounded chunk of a record batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a single longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = filled.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; together they are all rows."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """One fixed odd 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``size`` of each."""
    if len(_powers[0]) < size:
        length = max(size, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(length, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any slice follows at once."""
    forward, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(byte_values()[data] * forward[: len(data)], out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end); equal slices have equal hashes wherever they lie."""
    _, back = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


# What ends a phrase: punctuation and line breaks.
PHRASE_ENDS = b".,;:!?\n\x0b\x0c\r"


def _word_bytes(kind: str) -> np.ndarray:
    """Which bytes are inside words.

    ``alnum``: digits, letters, all beyond ASCII. ``space``: all but white space. ``phrase``: all but blanks and what ends a phrase.
    """
    table = np.zeros(256, dtype=bool)
    if kind == "alnum":
        for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
            table[low : high + 1] = True
    else:
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    if kind == "phrase":
        table[list(PHRASE_ENDS)] = False
    return table


def _lower_case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


INSIDE = {kind: _word_bytes(kind) for kind in ("alnum", "space", "phrase")}
LOWER = _lower_case()


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "alnum") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk: (hash, document number, first byte, end byte) of each, in order.

    A-Z count as a-z.
    ``offsets`` are those of the chunk's documents within ``data``.
    """
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = INSIDE[kind][data]
    edges = inside[1:] != inside[:-1]
    # a word never crosses a document edge
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = np.unique(inner[inside[inner] & inside[inner + 1]])
    bounds = np.flatnonzero(edges)
    starts, ends = bounds[0::2], bounds[1::2]
    if len(joined):
        starts, ends = np.sort(np.append(starts, joined)), np.sort(np.append(ends, joined))
    hashes = slice_hashes(prefix_sums(LOWER[data]), starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, owner, starts, ends


def word_ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of all n-grams; a document of fewer words, but not none, is one gram."""
    count = len(hashes)
    grams = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        part = np.zeros(count, dtype=np.uint64)
        part[: max(count - k, 0)] = hashes[k:]
        same = np.zeros(count, dtype=bool)
        same[: max(count - k, 0)] = owner[k:] == owner[: max(count - k, 0)]
        grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + np.where(same, part, np.uint64(k + 1)))
    full = np.zeros(count, dtype=bool)
    full[: max(count - n + 1, 0)] = owner[n - 1 :] == owner[: max(count - n + 1, 0)]
    first = np.ones(count, dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    kept = full | (first & ~full)
    return grams[kept], owner[kept]
