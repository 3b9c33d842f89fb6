"""Lexicons of any size in the row (M1): a perfect hash instead of a join.

The lexicon's tokens, with the degree words and negators, are hashed to 64
bits and numbered by a minimal perfect hash. Hash, valence, degree and negator
mark lie in arrays by that number (25 bytes a token), in a file that Spark copies
to each executor once. Its Python workers map the file, so they share its pages
and hold no copies, however long the lexicon is. A task looks up the tokens of a
slab of rows at once and sums each row's hits, so a row needs no id and there is
no explode, join or shuffle. Tokens count as equal if their 64-bit hashes are (of
a million entries and a billion different tokens, one is taken for another with a
chance of one in ten thousand). A lexicon of more than ``PART_ENTRIES`` becomes
several files, each built by itself, in which each slab is looked up in turn. The
files stay until the driver ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.perfect_hash import PerfectHash
from polarity.functions.word_runs import code_points, hashes_of, word_hashes

PART_ENTRIES = 8_000_000  # 200 MB
SLAB_BYTES = 1 << 18      # text of the tokens that are looked up at once
HASHED = 200_000          # lexicon tokens that the driver hashes at once
SUMS = T.StructType([T.StructField(n, T.DoubleType()) for n in "spn"] + [T.StructField("k", T.LongType())])


@dataclass
class LexiconArrays:
    hash: PerfectHash
    keys: np.ndarray
    valence: np.ndarray
    degree: np.ndarray
    negator: np.ndarray

    @classmethod
    def build(cls, tokens: Sequence[str] | pa.ChunkedArray, valences: Sequence[float], degree: Sequence[tuple[str, float]], negators: Sequence[str]) -> LexiconArrays:
        found = [_hashes(tokens[i:i + HASHED]) for i in range(0, len(tokens), HASHED)]
        own = np.concatenate([np.zeros(0, np.uint64), *found]), hashes_of([w for w, _ in degree]), hashes_of(list(negators))
        keys = np.unique(np.concatenate(own))
        if len(np.unique(own[0])) < len(own[0]):
            raise ValueError("two tokens of the lexicon have one hash")
        phash = PerfectHash.build(keys)
        at = phash.find(keys)
        out = cls(phash, np.empty_like(keys), *(np.zeros(len(keys)) for _ in range(2)), np.zeros(len(keys), bool))
        out.keys[at] = keys
        out.valence[phash.find(own[0])] = np.asarray(valences, np.float64)
        out.degree[phash.find(own[1])] = [d for _, d in degree]
        out.negator[phash.find(own[2])] = True
        return out

    def sums(self, hashes: np.ndarray, edges: np.ndarray, factor: float, context: int) -> tuple[np.ndarray, ...]:
        """Per row (tokens ``edges[i]:edges[i + 1]``): sum of valences, of v + 1 over v > 0, of 1 - v over v < 0, and number of v != 0."""
        rows = len(edges) - 1
        at = self.hash.find(hashes)
        at = np.where((at >= 0) & (self.keys[at] == hashes), at, -1) if self.hash.n else np.full(len(hashes), -1)
        value = _at(self.valence, at, 0.0)
        hit = np.flatnonzero(value != 0)
        row = np.searchsorted(edges, hit, side="right") - 1
        more, negated = np.zeros(len(hit)), np.zeros(len(hit), bool)
        for k in range(1, context + 1):
            before = hit - k
            there = np.where(before >= edges[row], at[np.maximum(before, 0)], -1)
            more += _at(self.degree, there, 0.0)
            negated |= _at(self.negator, there, False)
        v = (value[hit] + np.sign(value[hit]) * more) * np.where(negated, -factor, 1.0)
        add = lambda w, some: np.bincount(row[some], weights=w[some], minlength=rows)
        return add(v, v == v), add(v + 1, v > 0), add(1 - v, v < 0), np.bincount(row[v != 0], minlength=rows)


@dataclass
class LexiconFile:
    """A lexicon's arrays in a file of Spark's: each one's type, length and place."""
    name: str
    layout: list[tuple[str, int, int]]
    n: int

    @classmethod
    def share(cls, context: SparkContext, arrays: LexiconArrays) -> LexiconFile:
        """Write the arrays for all executors to copy."""
        out = cls(f"lexicon-{uuid.uuid4().hex}", [], arrays.hash.n)
        path = os.path.join(_folder().name, out.name)
        with open(path, "wb") as f:
            for a in (arrays.keys, arrays.valence, arrays.degree, arrays.negator, *arrays.hash.bits, *arrays.hash.before):
                f.write(b"\0" * (-f.tell() % 8))
                out.layout.append((a.dtype.str, len(a), f.tell()))
                f.write(np.ascontiguousarray(a).data)
        context.addFile(path)
        return out

    def mapped(self) -> LexiconArrays:
        """The arrays in the file's own pages, which the workers of a machine share."""
        raw = np.memmap(SparkFiles.get(self.name), np.uint8, "r").view(np.ndarray) if self.n else np.zeros(0, np.uint8)
        arrays = [raw[at:at + np.dtype(kind).itemsize * n].view(kind) for kind, n, at in self.layout]
        levels = (len(arrays) - 4) // 2
        return LexiconArrays(PerfectHash(arrays[4:4 + levels], arrays[4 + levels:], self.n), *arrays[:4])


@cache
def _folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="polarity-lexicon-")


def _hashes(tokens: Sequence[str] | pa.ChunkedArray) -> np.ndarray:
    return hashes_of(tokens.to_pylist() if isinstance(tokens, pa.ChunkedArray) else list(tokens))


def _at(values: np.ndarray, at: np.ndarray, other) -> np.ndarray:
    """``values[at]``, and ``other`` where ``at`` is -1."""
    return np.where(at >= 0, values[at], other) if len(values) else np.full(len(at), other)


def _slabs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their tokens have about ``most`` bytes; a longer row is alone."""
    for batch in batches:
        tokens = batch.column("_tokens")
        words = tokens.values
        kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
        places = np.frombuffer(words.buffers()[1], kind)[words.offset:] if len(words) else np.zeros(1, kind)
        size = places[tokens.offsets.to_numpy()]
        at = 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(size, int(size[at]) + most, side="right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _add(files: list[LexiconFile], names: list[str], factor: float, context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [f.mapped() for f in files]
        for rows in _slabs(batches, SLAB_BYTES):
            tokens = rows.column("_tokens")
            edges = tokens.offsets.to_numpy().astype(np.int64)
            points, cut = code_points(tokens.values.slice(edges[0], edges[-1] - edges[0]))
            hashes, edges = word_hashes(points, cut[:-1], cut[1:]), edges - edges[0]
            sums = [np.zeros(rows.num_rows) for _ in "spn"] + [np.zeros(rows.num_rows, np.int64)]
            for part in parts:
                sums = [x + y for x, y in zip(sums, part.sums(hashes, edges, factor, context))]
            found = pa.StructArray.from_arrays([pa.array(x) for x in sums], names=["s", "p", "n", "k"])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), found, pa.array(np.diff(edges).astype(np.int32))], names=[*names, "_sums", "_n_tokens"])

    return run


def with_sums(df: DataFrame, tokens: Column, lexicon: DataFrame, negators: Sequence[str], degree: Sequence[tuple[str, float]],
              factor: float, context: int) -> DataFrame:
    """``df`` with ``_sums`` (s, p, n, k) of its tokens and ``_n_tokens``. Entries
    that repeat a token with one valence count once; with another one they are an error."""
    spark = df.sparkSession
    entries = (lexicon.select("token", F.col("valence").cast("double").alias("valence")).filter("token IS NOT NULL AND valence IS NOT NULL")
               .groupBy("token").agg(F.min("valence").alias("valence"), F.max("valence").alias("other")))
    n, clash = entries.agg(F.count("*"), F.min(F.when(F.col("valence") != F.col("other"), F.col("token")))).first()
    if clash is not None:
        raise ValueError(f"the lexicon gives {clash!r} more than one valence")
    # tokens without a value are hits of no kind
    entries, parts = entries.filter("valence != 0"), max(1, -(-n // PART_ENTRIES))
    names = [f"c{i}" for i in range(len(df.columns))]
    empty = F.array().cast("array<string>")
    rows = df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(m) for c, m in zip(df.columns, names)), F.coalesce(tokens, empty).alias("_tokens"))
    kind = T.StructType([*(T.StructField(m, f.dataType) for m, f in zip(names, df.schema)), T.StructField("_sums", SUMS), T.StructField("_n_tokens", T.IntegerType())])
    files = []
    for part in range(parts):
        own = entries.filter(F.pmod(F.xxhash64("token"), F.lit(parts)) == part) if parts > 1 else entries
        found = own.select("token", "valence").toArrow()
        arrays = LexiconArrays.build(found.column("token"), found.column("valence").to_numpy(), degree, negators)
        files.append(LexiconFile.share(spark.sparkContext, arrays))
    rows = rows.mapInArrow(_add(files, names, factor, context), kind)
    return rows.select(*(F.col(m).alias(c) for m, c in zip(names, df.columns)), "_sums", "_n_tokens")
