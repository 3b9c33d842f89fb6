"""Words of Arrow string columns as numpy arrays, without a Python loop per row.

A batch of texts is one byte buffer with row offsets. Words are runs of bytes
outside a separator table; every word gets a 64-bit hash, and the hash of any
run of words follows from prefix sums. Hashes are polynomial sums modulo 2**64
over random byte codes, passed through a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLANKS = (0x20, *range(0x09, 0x0E))


def _table(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: bytes that belong to a word, by rule
NOT_BLANK = _table(BLANKS)
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Poly:
    """One polynomial hash family: byte codes, a base and cached powers."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.codes = r.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(r.integers(2**61, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            full = np.full(n, self.base, dtype=np.uint64)
            full[0] = 1
            self.up = np.cumprod(full)
            full[1:] = self.inverse
            self.down = np.cumprod(full)

    def of_runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for every run."""
        n = len(values)
        self.powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


A, B = Poly(20261), Poly(20262)


class Words:
    """Words of a run of rows. ``first[i]:first[i + 1]`` are the words of row i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool):
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets
        n = len(buf)
        word = np.zeros(n + 2, dtype=bool)
        word[1:-1] = inside[self.buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True  # a word never crosses two rows
        here, left = word[1:], word[:-1]
        self.starts = np.flatnonzero(here & (~left | cut))
        self.ends = np.flatnonzero(left & (~here | cut))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self):
        return len(self.starts)

    def hashes(self, poly: Poly = A) -> np.ndarray:
        return poly.of_runs(poly.codes[self.buf], self.starts, self.ends)


def grams(h: np.ndarray, n: int, poly: Poly = A) -> np.ndarray:
    """Hash of every n consecutive word hashes (runs over row ends included)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    i = np.arange(len(h) - n + 1)
    return poly.of_runs(h, i, i + n)


def inside_rows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of every n-word run that stays inside its row."""
    room = np.maximum(words.counts - n + 1, 0)
    row = np.repeat(np.arange(len(room)), room)
    begin = np.cumsum(room) - room
    return np.arange(len(row)) - begin[row] + words.first[:-1][row], row


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def leftmost_min(x: np.ndarray, n: int, most: int = 1 << 24) -> np.ndarray:
    """Place of the smallest of every ``n`` consecutive hashes. Hashes are
    compared by their upper bits (40 of 64), equal ones by their place. Arrays
    longer than ``most`` are taken in stretches that overlap by n - 1."""
    low = U(most - 1)
    out = [np.zeros(0, np.int64)]
    for at in range(0, max(len(x) - n + 1, 0), most - n + 1):
        part = x[at:at + most]
        keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(keyed, n) & low).astype(np.int64) + at)
    return np.concatenate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[tuple]:
    """(rows, bytes, offsets): whole rows of about ``most`` text bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), buf[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to
