"""Vectorised word kernels over Arrow string buffers.

Everything works on the UTF-8 bytes of a block of documents at once, so no
Python object is made per word.  A word is ``[^\\x20\\x09-\\x0D]+``; a word's hash
is a polynomial over byte codes modulo 2**64, mixed; an n-gram's hash is a
polynomial over its words' hashes.  All constants come from one fixed seed, so
hashes agree between tasks, retries and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1024

_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(1, 256)
_BASES = [int(x) | 1 for x in _splitmix(2, 4)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        got = np.cumprod(full, dtype=np.uint64)
        if size <= 1 << 20:
            _POWERS[base] = got
    return got[:n]


class Block:
    """The words of some documents.

    ``data`` bytes, ``starts``/``ends`` byte range of each word, ``first`` index of
    each document's first word (one more entry than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        word = ~_SPACE[data]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        total = int(lengths.sum())
        skip = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(skip, lengths)
        terms = _BYTE[self.data[place + np.repeat(self.starts, lengths)]]
        terms *= _powers(_BASES[0], int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, skip) + lengths.astype(np.uint64))

    def ngrams(self, hashes: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every n-gram that lies in one document, and each document's range in it (offsets)."""
        counts = np.maximum(self.counts - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        total = int(first[-1])
        if not total:
            return np.zeros(0, dtype=np.uint64), first
        base = _BASES[1 + which]
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        factor = 1
        if n <= 8:
            for k in range(n):
                out += hashes[k : k + len(out)] * np.uint64(factor)
                factor = factor * base & _MASK
        else:
            inverse = pow(base, -1, 1 << 64)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)])
            out = (sums[n:] - sums[:-n]) * _powers(inverse, len(out))
        at = np.arange(total) + np.repeat(self.first[:-1] - first[:-1], counts)
        return mix(out[at] + np.uint64(n)), first


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Split a string column into blocks of whole rows of about ``limit`` bytes: (first row, end row, block).

    A longer text makes a block of its own.  Null texts hold no words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for row in range(0, len(column), BLOCK_ROWS):
        for at, end, block in _blocks(column.slice(row, BLOCK_ROWS).cast(pa.large_string()), lower, limit):
            yield row + at, row + end, block


def _blocks(column: pa.Array, lower: bool, limit: int) -> Iterator[tuple[int, int, Block]]:
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], lower)
        at = end
