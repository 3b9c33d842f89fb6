"""Benchmark decontamination by winnowing.

Of every ``n`` consecutive words of an item or a document, the smallest hash
among the ``n - k + 1`` k-grams inside is kept with its place (the leftmost if
equal). The choice depends on the window's words alone, so two equal windows
keep the same k-gram at the same offset: every shared span of ``n`` words or
more meets in at least one fingerprint. Fingerprints of documents and items
are joined, and each hit is extended word by word over the ``n - k`` words to
either side to find the whole shared windows.

An item of fewer than ``n`` words (but not none) is one window of its own
length; document runs of the lengths that occur are joined with it directly.

A Bloom filter of the items' fingerprints, of fixed size whatever the number
of items, lets a document task drop most fingerprints that no item has; the
join decides. The join key is salted on the document's side, so that a passage
that a third of all documents share is dealt over ``SALTS`` tasks.

Null and empty texts have no words and no hits. A null item id counts as the
empty string. Repeated rows are separate rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.scratch import lean
from polarity.llm.words import ALNUM, U, Words, grams, inside_rows, leftmost_min, mix, pieces

N = 10
K = 6
FILTER_BITS = 1 << 24
SALTS = 16


def _marks(words: Words, h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of each kept k-gram, once."""
    start, row = inside_rows(words, n)
    if not len(start):
        return start, row
    at = leftmost_min(mix(grams(h, k)), n - k + 1)[start]
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    return at[new], row[new]


def _around(words: Words, h: np.ndarray, at: np.ndarray, row: np.ndarray, before: int, after: int) -> np.ndarray:
    """Word hashes from ``before`` words left of ``at``; 0 outside the row."""
    i = at[:, None] + np.arange(-before, after)
    ok = (i >= words.first[row][:, None]) & (i < words.first[row + 1][:, None])
    return np.where(ok, h[np.clip(i, 0, len(h) - 1)], U(0))


def _lists(a: np.ndarray) -> pa.Array:
    edges = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(a.ravel().view(np.int64)))


def _item_prints(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in pieces(batches, "text"):
            words = Words(buf, offsets, ALNUM, lower=True)
            h = words.hashes()
            items = rows.column("item")
            at, row = _marks(words, h, n, k)
            found = [(np.full(len(at), n), grams(h, k)[at] if len(at) else h[:0], row, _around(words, h, at, row, n - k, n))] if len(at) else []
            for size in range(1, n):
                short = np.flatnonzero(words.counts == size)
                if len(short):
                    at = words.first[short]
                    found.append((np.full(len(at), size), grams(h, size)[at], short, h[at[:, None] + np.arange(size)]))
            for kind, prints, row, around in found:
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(prints.view(np.int64)), items.take(pa.array(row)), _lists(around)],
                                                 names=["kind", "print", "item", "item_words"])

    return run


def _document_prints(n: int, k: int, lengths: list[int], bits, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").view(bool)
        low = U(size - 1)
        number = TaskContext.get().partitionId() << 33
        for rows, buf, offsets in pieces(batches, "text"):
            words = Words(buf, offsets, ALNUM, lower=True)
            h = words.hashes()
            numbers = number + np.arange(rows.num_rows)
            number += rows.num_rows
            found = []
            at, row = _marks(words, h, n, k)
            if len(at):
                found.append((n, at, row, grams(h, k)[at], n - k, n))
            for m in lengths:
                at, row = inside_rows(words, m)
                if len(at):
                    found.append((m, at, row, grams(h, m)[at], 0, m))
            none = pa.nulls(rows.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("key"), pa.array(numbers), pa.array(words.counts.astype(np.int64)), pa.array(np.zeros(rows.num_rows, np.int32)),
                                              pa.array(numbers), pa.array(np.zeros(rows.num_rows, np.int32)), none], names=_NAMES)
            for kind, at, row, prints, before, after in found:
                ok = held[prints & low] & held[(prints >> U(32)) & low]
                if not ok.any():
                    continue
                at, row, prints = at[ok], row[ok], prints[ok]
                place = (at - words.first[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), rows.column("key").take(pa.array(row)), pa.array(numbers[row]), pa.array(words.counts[row].astype(np.int64)),
                                                  pa.array(np.full(len(at), kind, np.int32)), pa.array(prints.view(np.int64)), pa.array(place), _lists(_around(words, h, at, row, before, after))], names=_NAMES)

    return run


_NAMES = ["id", "key", "number", "n_words", "kind", "print", "place", "words"]


def benchmark_prints(items: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N, k: int = K) -> DataFrame:
    """Kept fingerprints of the items with the words around them."""
    return (items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
            .mapInArrow(lean(_item_prints(n, k)), "kind int, print long, item string, item_words array<long>"))


def _filter_bits(prints: DataFrame, size: int) -> bytes:
    """Bloom filter with two bits a fingerprint: at most size / 64 rows reach the driver."""
    places = prints.select(F.explode(F.array(F.col("print").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("print", 32).bitwiseAND(F.lit(size - 1)))).alias("p"))
    lanes = places.groupBy(F.shiftright("p", 5).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("bits")).collect()
    out = np.zeros(size // 32, dtype=np.uint32)
    for r in lanes:
        out[r["lane"]] = r["bits"]
    return out.tobytes()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", n: int = N, k: int = K) -> DataFrame:
    """One row per row of ``docs``: its id, ``key`` (a hash of its text),
    ``n_words``, ``spans`` (sorted word spans of shared windows) and ``items``
    (sorted ids of the items that share one)."""
    if not 1 <= k <= n:
        raise ValueError("k must be between 1 and n")
    spark = docs.sparkSession
    prints = benchmark_prints(items, item_col, item_text_col, n, k)
    lengths = sorted(r[0] for r in prints.filter(F.col("kind") < n).select("kind").distinct().collect())
    bits = spark.sparkContext.broadcast(_filter_bits(prints, FILTER_BITS))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        lean(_document_prints(n, k, lengths, bits, FILTER_BITS)), "id long, key int, number long, n_words long, kind int, print long, place int, words array<long>")
    sides = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = found.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int")).join(sides, ["kind", "print", "salt"], "left")
    same = f"i -> words[i] = item_words[i] AND words[i] != 0"
    spans = F.expr(f"""CASE WHEN kind = {n} THEN transform(filter(sequence(0, {n - k}), s -> forall(sequence(s, s + {n - 1}), {same})),
                         s -> named_struct('first', place - {n - k} + s, 'last', place + {k} + s))
                       WHEN kind > 0 AND item_words IS NOT NULL AND forall(sequence(0, kind - 1), {same})
                         THEN array(named_struct('first', place, 'last', place + kind)) END""")
    # a k-gram that only hashes alike, or stands in no whole window, gives no span
    spans = F.when(F.col("item").isNotNull() & (F.size(spans) > 0), spans)
    return (hits.withColumn("s", spans).withColumn("item", F.when(F.col("s").isNotNull(), F.col("item")))
            .groupBy("number").agg(F.first("id").alias(id_col), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("spans"),
                                   F.array_sort(F.collect_set("item")).alias("items")).drop("number"))


def covered(spans: str = "spans") -> F.Column:
    """Number of words in the union of sorted spans."""
    return F.expr(f"""aggregate({spans}, named_struct('upto', 0, 'n', 0L),
        (a, s) -> named_struct('upto', greatest(a.upto, s.last), 'n', a.n + greatest(0, s.last - greatest(a.upto, s.first))), a -> a.n)""")
