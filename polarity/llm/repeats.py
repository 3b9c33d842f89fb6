"""Removal of passages that occur more than once (exact substring dedup).

Super-k-mer partitioning. A window is ``window`` consecutive words. Its
minimiser is the smallest hash among its ``mer``-word runs. Consecutive
windows with one minimiser form a super-k-mer, which travels as one packed
string to the bucket of the minimiser's value, so equal windows always meet in
one bucket. There the windows are cut out of the strings again, their 128-bit
fingerprints sorted, and equal neighbours counted.

A map task sends each distinct super-k-mer of a chunk once, whatever the
number of its copies: copies inside the chunk already repeat each other. So a
passage held by a third of all rows costs its bucket one string per chunk. At
its edges the strings hold each row's own words and differ; a minimiser of many
different strings is found by a count beforehand, and its windows are dealt one
by one, as fingerprints, by the value of the fingerprint.

In a chunk a row has a number of two bytes, which its super-k-mers carry; the
chunk's head has the 128-bit digest of each row's text. What is repeated in a
text depends on the text alone, so spans go back to rows by that digest.

Null and empty texts have no words. Equal rows are separate rows whose windows
repeat each other, whatever their ids. A null id is kept as it is. Only the
text column is read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.scratch import lean, lean_group, materialise, scratch_scope, text_bytes
from polarity.llm.words import NOT_BLANK, U, A, B, Words, grams, inside_rows, leftmost_min, mix, pieces

WINDOW = 35
MER = 4
CHUNK_WORDS = 1_500_000  # words of which a map task gathers super-k-mers before it sends them
BUCKET_BYTES = 8 << 20   # packed text that a bucket holds on average
HOT_STRINGS = 20_000     # strings of a minimiser whose windows are dealt one by one
MOST_HOT = 1_000_000     # such minimisers; beyond, only those of more strings than the data over this
CHUNK_ROWS = 60_000      # row numbers of a chunk fit 16 bits

_PACKED = "bucket int, chunk long, strings binary, lengths binary, rows binary, first binary, copies binary"
_SPANS = "chunk long, row int, first int, last int, digest_a long, digest_b long"


def _packed(bucket, chunk, strings, lengths, rows, first, copies):
    blob = zstandard.ZstdCompressor(level=1).compress
    return (bucket, chunk, blob(strings), blob(lengths.astype(np.int32).tobytes()), blob(rows.astype(np.uint16).tobytes()),
            blob(first.astype(np.int32).tobytes()), copies.astype(np.int8).tobytes())


def _head(bucket, chunk, digests):
    """The digests of a chunk's rows, in place of strings."""
    return (bucket, chunk, np.concatenate(digests, axis=1).tobytes(), None, None, None, None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("strings", "lengths", "rows", "first", "copies"))])
_SPANS_ARROW = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("digest_a", pa.int64()), ("digest_b", pa.int64())])


def _super_kmers(words: Words, window: int, mer: int):
    """Per super-k-mer: first word, number of words, row, minimiser, hash of its words."""
    none = np.zeros(0, dtype=np.int64)
    h = words.hashes()
    start, row = inside_rows(words, window)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    m = mix(grams(h, mer))
    at = leftmost_min(m, window - mer + 1)[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(start))) + window - 1
    w0 = start[begin]
    return w0, size, row[begin], m[at[begin]], A.of_runs(h, w0, w0 + size) ^ size.astype(np.uint64)


def _many(window: int, mer: int, every: int):
    """(minimiser, n) of each chunk's different strings whose hash falls on one of ``every`` parts."""
    def emit(chunk):
        minimiser, name = (np.concatenate(c) for c in zip(*chunk))
        found, n = np.unique(minimiser[np.unique(name, return_index=True)[1]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["minimiser", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for _, buf, offsets in pieces(batches, "text"):
            words = Words(buf, offsets, NOT_BLANK, lower=False)
            minimiser, name = _super_kmers(words, window, mer)[3:]
            some = mix(name) % U(every) == 0
            chunk.append((minimiser[some], name[some]))
            held += len(words)
            if held >= CHUNK_WORDS:
                yield emit(chunk)
                chunk, held = [], 0
        if chunk:
            yield emit(chunk)

    return run


def _send(window: int, mer: int, buckets: int, shared):
    def packed(name, bucket, chosen, pack):
        """One record for each bucket that chosen rows fall into, in batches."""
        rows = []
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            rows.append(pack(int(bucket[part[0]]), chosen[part], part))
            if len(rows) >= 256:
                yield _batch(rows, _PACKED_ARROW)
                rows = []
        if rows:
            yield _batch(rows, _PACKED_ARROW)

    def settled(name, size, row, first, again):
        """Copies within the chunk repeat each other, whatever other chunks hold."""
        yield _batch([_packed(name % buckets, name, b"", size[again], row[again], first[again], np.zeros(0))], _PACKED_ARROW)

    def emit_windows(name, chunk):
        a, b, row, first = (np.concatenate(c) for c in zip(*chunk))
        _, index, inverse, count = np.unique(a ^ mix(b), return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inverse] > 1)
        if len(again):
            yield from settled(name, np.full(len(a), window), row, first, again)
        yield from packed(name, (a[index] % U(buckets)).astype(np.int64), index, lambda bucket, i, part: _packed(
            bucket, name, a[i].tobytes() + b[i].tobytes(), np.zeros(0), row[i], first[i], np.minimum(count[part], 2)))

    def emit_strings(name, chunk):
        strings, length, size, row, first, minimiser, words = (sum(c, []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*chunk))
        _, index, inverse, count = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inverse] > 1)
        if len(again):
            yield from settled(name, size, row, first, again)
        yield from packed(name, (minimiser[index] % U(buckets)).astype(np.int64), index, lambda bucket, i, part: _packed(
            bucket, name, b"".join([strings[j] for j in i]), length[i], row[i], first[i], np.minimum(count[part], 2)))

    def emit(name, digests, chunk, windows):
        yield _batch([_head(name % buckets, name, digests)], _PACKED_ARROW)
        if chunk:
            yield from emit_strings(name, chunk)
        if windows:
            yield from emit_windows(name, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        name = TaskContext.get().partitionId() << 32
        digests, chunk, windows, held, docs = [], [], [], 0, 0
        for rows, buf, offsets in pieces(batches, "text"):
            for at in range(0, rows.num_rows, CHUNK_ROWS):
                part = rows.slice(at, CHUNK_ROWS)
                o = offsets[at:at + part.num_rows + 1]
                if held >= CHUNK_WORDS or docs + part.num_rows > CHUNK_ROWS:
                    yield from emit(name, digests, chunk, windows)
                    name, digests, chunk, windows, held, docs = name + 1, [], [], [], 0, 0
                words = Words(buf[o[0]:o[-1]], o - o[0], NOT_BLANK, lower=False)
                found = _super_kmers(words, window, mer)
                many = np.isin(found[3], hot)
                if many.any():
                    w0, size, row = (x[many] for x in found[:3])
                    n = size - window + 1
                    w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w0, n)
                    row = np.repeat(row, n)
                    windows.append((A.of_runs(words.hashes(A), w, w + window), B.of_runs(words.hashes(B), w, w + window), row + docs, w - words.first[row]))
                w0, size, row, minimiser, hashed = (x[~many] for x in found)
                if len(w0):
                    a, b = words.starts[w0], words.ends[w0 + size - 1]
                    raw = words.buf.tobytes()
                    chunk.append(([raw[s:e] for s, e in zip(a.tolist(), b.tolist())], b - a, size, row + docs, w0 - words.first[row], minimiser, hashed))
                digests.append(np.stack([part.column(c).to_numpy() for c in ("digest_a", "digest_b")]))
                held, docs = held + len(words), docs + part.num_rows
        if docs:
            yield from emit(name, digests, chunk, windows)

    return run


def _count(window: int):
    """Windows of one bucket that occur at least twice, as word spans of their rows."""
    def run(table: pa.Table) -> pa.Table:
        blob = zstandard.ZstdDecompressor().decompress
        heads, settled, held = [], [], []
        prints_a, prints_b, string, copies_of, offset = [], [], [], [], []
        begin = 0
        for r in table.to_pylist():
            if r["copies"] is None:
                heads.append((r["chunk"], np.frombuffer(r["strings"], np.int64).reshape(2, -1)))
                continue
            length = np.frombuffer(blob(r["lengths"]), np.int32)
            row = np.frombuffer(blob(r["rows"]), np.uint16)
            whose = (np.full(len(row), r["chunk"]), row, np.frombuffer(blob(r["first"]), np.int32))
            if not r["copies"]:
                settled.append((*whose, whose[2] + length))
                continue
            held.append(whose)
            copies = np.frombuffer(r["copies"], np.int8)
            if not len(length):  # windows by fingerprint
                prints = np.frombuffer(blob(r["strings"]), np.uint64)
                prints_a.append(prints[:len(copies)])
                prints_b.append(prints[len(copies):])
                string.append(np.arange(len(copies)) + begin)
                copies_of.append(copies)
                offset.append(np.zeros(len(copies), np.int64))
                begin += len(copies)
                continue
            buf = np.frombuffer(blob(r["strings"]), np.uint8)
            edges = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            at = 0
            while at < len(length):
                to = min(max(int(np.searchsorted(edges, edges[at] + (1 << 19), side="right")) - 1, at + 1), len(length))
                words = Words(buf[edges[at]:edges[to]], edges[at:to + 1] - edges[at], NOT_BLANK, lower=False)
                start, row = inside_rows(words, window)
                prints_a.append(A.of_runs(words.hashes(A), start, start + window))
                prints_b.append(B.of_runs(words.hashes(B), start, start + window))
                string.append(row + at + begin)
                copies_of.append(copies[row + at])
                offset.append(start - words.first[row])
                at = to
            begin += len(length)
        spans = [tuple(np.concatenate(c) for c in zip(*settled))] if settled else []
        if prints_a:
            a, b = np.concatenate(prints_a), np.concatenate(prints_b)
            string, copies, offset = np.concatenate(string), np.concatenate(copies_of).astype(np.int64), np.concatenate(offset)
            order = np.argsort(a, kind="stable")
            if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
                order = np.lexsort((b, a))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=copies[order])
            repeated = np.zeros(len(order), dtype=bool)
            repeated[order] = total[group] > 1
            hit = np.flatnonzero(repeated & (copies < 2))  # the other strings are settled by their chunk
            if len(hit):
                cut = np.ones(len(hit), dtype=bool)
                cut[1:] = (string[hit][1:] != string[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)
                i = np.flatnonzero(cut)
                j = np.append(i[1:], len(hit)) - 1
                chunk, row, first = (np.concatenate(c) for c in zip(*held))
                s = string[hit[i]]
                spans.append((chunk[s], row[s], first[s] + offset[hit[i]], first[s] + offset[hit[j]] + window))
        out = []
        for chunk, digests in heads:
            n = digests.shape[1]
            out.append(pa.table([np.full(n, chunk), np.arange(n, dtype=np.int32), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), digests[0], digests[1]], schema=_SPANS_ARROW))
        if spans:
            chunk, row, first, last = (np.concatenate(c) for c in zip(*spans))
            none = pa.nulls(len(chunk), pa.int64())
            out.append(pa.table([chunk, row.astype(np.int32), first.astype(np.int32), last.astype(np.int32), none, none], schema=_SPANS_ARROW))
        return pa.concat_tables(out) if out else _SPANS_ARROW.empty_table()

    return run


def _digests(text: str) -> list[F.Column]:
    """Two hashes of a text, 128 bits together."""
    return [F.xxhash64(F.lit(1), text).alias("digest_a"), F.xxhash64(F.lit(2), text).alias("digest_b")]


def _hot(df: DataFrame, text_col: str, window: int, mer: int) -> np.ndarray:
    """Minimisers of many strings, estimated from every so many-th string; MOST_HOT of them at most."""
    every = max(1, HOT_STRINGS // 64)
    counts = df.select(F.col(text_col).alias("text")).mapInArrow(lean(_many(window, mer, every)), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(HOT_STRINGS // every, total // MOST_HOT)
    return counts.filter(F.col("n") >= least).select("minimiser").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)


def _sent(df: DataFrame, text_col: str, window: int, mer: int, buckets: int) -> DataFrame:
    """Packed super-k-mers and, of hot minimisers, windows, with their buckets."""
    with scratch_scope(df.sparkSession):
        hot = df.sparkSession.sparkContext.broadcast(_hot(df, text_col, window, mer))
    return df.select(F.col(text_col).alias("text"), *_digests(text_col)).mapInArrow(lean(_send(window, mer, buckets, hot)), _PACKED)


def repeated_spans(df: DataFrame, text_col: str = "text", window: int = WINDOW, mer: int = MER) -> DataFrame:
    """Word spans ``[first, last)`` of each text that repeated windows cover:
    one row per text that has some, by its digest, with ``spans`` sorted by their first word."""
    if not 1 <= mer <= window:
        raise ValueError("mer must be between 1 and window")
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * text_bytes(df, text_col) // BUCKET_BYTES))
    found = _sent(df, text_col, window, mer, buckets).groupBy("bucket").applyInArrow(lean_group(_count(window)), _SPANS)
    spans = F.sort_array(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last"))))
    of_rows = found.groupBy("chunk", "row").agg(spans.alias("spans"), F.max("digest_a").alias("digest_a"), F.max("digest_b").alias("digest_b"))
    # rows of one text have the same spans
    return of_rows.filter(F.size("spans") > 0).groupBy("digest_a", "digest_b").agg(F.first("spans").alias("spans"))


_KEPT_ARROW = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in pieces(batches, "__text"):
        rest = [c for c in part.schema.names if c not in ("__spans", "__text")]
        out = []
        for text, spans in zip(part.column("__text").to_pylist(), part.column("__spans").to_pylist()):
            words = (text or "").encode().split()
            keep, at = [], 0
            for s in spans or ():
                keep += words[at:s["first"]]
                at = max(at, s["last"])
            keep += words[at:]
            out.append((len(words), len(words) - len(keep), b" ".join(keep).decode()))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(c, type=f.type) for c, f in zip(zip(*out), _KEPT_ARROW))],
                                         names=[*rest, *_KEPT_ARROW.names])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   mer: int = MER, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``n_words``, ``n_removed`` and ``kept``: the
    words outside all repeated windows, joined by one space. ``carry`` names
    the columns to return beside them (the id alone if None); they may bear
    any name but these three."""
    carry = [id_col] if carry is None else carry
    spans = repeated_spans(df, text_col, window, mer)
    left = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text_col).alias("__text"), *_digests(text_col))
    rows = left.join(spans.withColumnRenamed("spans", "__spans"), ["digest_a", "digest_b"], "left").drop("digest_a", "digest_b")
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    done = rows.mapInArrow(lean(_cut), f"{kinds}{', ' if kinds else ''}n_words long, n_removed long, kept string")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n_words", "n_removed", "kept")
