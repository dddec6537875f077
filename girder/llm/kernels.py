"""Array kernels used inside tasks: word hashes, shingle sets and batching of texts.

All of them see one Arrow batch at a time and work on byte arrays, so a task
holds a few megabytes whatever the size of the table or of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


def byte_values(fold: bool = True) -> np.ndarray:
    """A random 64-bit value per byte; with ``fold`` A-Z share those of a-z."""
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * GOLDEN) | np.uint64(1)


def powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class WordHasher:
    """Hashes of the words of texts: runs of bytes other than space and \\x09-\\x0D, A-Z as a-z."""

    def __init__(self, beginnings: tuple[int, ...] = ()) -> None:
        """With ``beginnings``, also hashes of the first so many bytes of each word; 0 for a shorter word."""
        self.beginnings = beginnings
        self.spaces = space_table()
        self.values = byte_values()
        self.up = powers(PIECE, BASE)
        self.down = powers(PIECE, BASE_INVERSE)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(n, BASE), powers(n, BASE_INVERSE)

    def _cut(self, text: bytes) -> Iterator[bytes]:
        """Pieces of a long text that end at white space."""
        start = 0
        while len(text) - start > PIECE:
            end = start + PIECE
            tail = np.frombuffer(text, np.uint8, offset=end)
            for at in range(0, len(tail), 1 << 16):
                stops = np.flatnonzero(self.spaces[tail[at : at + (1 << 16)]])
                if len(stops):
                    end += at + int(stops[0])
                    break
            else:
                end = len(text)
            yield text[start:end]
            start = end
        yield text[start:]

    def _hash(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        self._grow(len(joined) + 1)
        blank = self.spaces[joined]
        before = np.empty_like(blank)
        before[0] = True
        before[1:] = blank[:-1]
        starts = np.flatnonzero(~blank & before)
        ends = np.flatnonzero(blank & ~before)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(self.values[joined] * self.up[: len(joined)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
        if self.beginnings:
            rows = [hashes]
            for n in self.beginnings:
                first = mix((sums[np.minimum(starts + n, ends)] - sums[starts]) * self.down[starts] + np.uint64(n << 32))
                rows.append(np.where(ends - starts >= n, first, np.uint64(0)))
            hashes = np.stack(rows)
        bounds = np.cumsum([len(p) + 1 for p in pieces])
        return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All word hashes in order (with beginnings: a row for each kind), and how many each text has."""
        counts = np.zeros(len(texts), np.int64)
        found: list[np.ndarray] = []
        owners: list[int] = []
        pieces: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal owners, pieces, size
            if pieces:
                hashes, per = self._hash(pieces)
                found.append(hashes)
                np.add.at(counts, owners, per)
            owners, pieces, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in self._cut(text) if len(text) > PIECE else (text,):
                if size + len(piece) > PIECE:
                    flush()
                owners.append(i)
                pieces.append(piece)
                size += len(piece)
        flush()
        if not found:
            found = [np.zeros((1 + len(self.beginnings), 0) if self.beginnings else 0, np.uint64)]
        return np.concatenate(found, axis=-1), counts


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text in order; a shorter text is one shingle as a whole."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + words[k : len(words) - width + 1 + k]
    return mix(out + np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about ``limit`` bytes, one row at least."""
    texts = batch.column(column)
    sizes = [0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()]
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)
