"""Words of Arrow text batches as arrays: code points, word bounds, 64-bit hashes.

A batch of texts is one array of code points with the edges of its rows. Words
are runs of code points of a class table; a word's hash is a polynomial over its
code points. No step loops over rows or words in Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP, _DOWN = [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


@cache
def letters_and_digits() -> np.ndarray:
    """True for the code points of letters (L*) and numbers (N*)."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)])


@cache
def not_blank() -> np.ndarray:
    """True for all code points but blanks (as ``str.split`` sees them)."""
    return np.array([not chr(c).isspace() for c in range(sys.maxunicode + 1)])


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, edges of the rows); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, starts[offsets - offsets[0]]


def slabs(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = min(max(int(np.searchsorted(size, before + most, side="right")), at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(points: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; a word never crosses two rows."""
    here = np.zeros(len(points) + 2, dtype=bool)
    here[1:-1] = inside[points]
    cut = np.zeros(len(points) + 1, dtype=bool)
    cut[edges] = True
    start = np.flatnonzero(here[1:] & (~here[:-1] | cut))
    end = np.flatnonzero(here[:-1] & (~here[1:] | cut))
    return start, end, np.searchsorted(edges, start, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_UP[0]) < n:
        n = max(n, 2 * len(_UP[0]))
        for held, base in ((_UP, int(_BASE)), (_DOWN, pow(int(_BASE), -1, 1 << 64))):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            held[0] = np.cumprod(step)
    return _UP[0], _DOWN[0]


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash; one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the code points of each run [start, end)."""
    up, down = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(finish(points.astype(np.uint64) + np.uint64(1)) * up[:len(points)], out=sums[1:])
    return finish((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hashes_of(words: list[str]) -> np.ndarray:
    """Hash of each whole string, as ``word_hashes`` gives it for a word."""
    points, edges = code_points(pa.array(words, pa.string()))
    return word_hashes(points, edges[:-1], edges[1:])
