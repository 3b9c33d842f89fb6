"""Token files: documents as id streams in range-coded blocks.

Encoding splits texts at places where the tokenizer surely splits too (before a
blank that follows a visible character and, if it is byte-level, between a letter
and a sign), so that a worker gives each distinct piece to the tokenizer once and
looks it up afterwards; the ids are those of whole texts. Added tokens (such as an end-of-text mark) that stand in a text are
one id each, as in the library by default. ``end_id`` closes each document.

Texts are dealt by ranges of their id (and, for rows of one id, of the text's
hash) and sorted, then one pass encodes, codes and writes them, so each file
holds a run of documents in ascending order. A file is a sequence of groups, each framed by
its length: an index (document ids and counts, checksummed), a table of blocks
and their words (see ``token_coder``). Spark's text sink writes a group as one
row of bytes and Spark's binary source reads files back, so files can be in any
store. A document longer than what is left of a group goes on in the next one.

Null and empty texts are documents of the end id alone. A null document id
sorts first and stays null. Rows of one id follow each other by their text's hash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polarity.llm.scratch import text_bytes
from polarity.llm.token_coder import BLOCK, decode, encode
from polarity.llm.words import BLANKS, A, pieces, text_buffer

NO_ID = -(1 << 63)
GROUP_IDS = 5 << 20       # ids that are coded side by side
SLAB_BYTES = 4 << 20      # text bytes that are tokenised at once
FILE_BYTES = 20 << 20     # text bytes whose ids make a file, on average
KNOWN_PIECES = 2_000_000  # pieces a worker remembers before it starts anew
KNOWN_IDS = 16_000_000    # and their ids
_MAGIC = b"TOK2"
_HEAD = struct.Struct("<4sIIIIQ")  # magic, documents, blocks, vocabulary, bytes of the index, ids
_BLOCK = struct.Struct("<III")     # ids, checksum, bytes
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_WORDS = re.compile(r"[A-Za-z ]*")
_LETTER = np.array([chr(c).isalpha() and c < 0x80 for c in range(256)])


def _splits_at_words(tokenizer_json: str) -> bool:
    """Whether this is a byte-level tokenizer whose own rule takes a run of letters,
    with a blank before it or without, as one word whatever stands beside it."""
    given = json.loads(tokenizer_json)
    split, model = given.get("pre_tokenizer") or {}, given["model"]
    return (given.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout"))


class PieceEncoder:
    """Ids of texts through a tokenizer, each distinct piece encoded once. With
    ``special_as_text`` special tokens that stand in a text are split as any text."""

    def __init__(self, tokenizer_json: str, special_as_text: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        lengths = [len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)]
        self.by_words = _splits_at_words(tokenizer_json) and not any(t.single_word or _WORDS.fullmatch(t.content) for t in added.values())
        blank = [t.content.encode() for t in added.values() if t.rstrip or _BLANK[list(t.content.encode())].any()]
        self.beside = not blank  # no added token reaches over a blank
        self.wide = [t.content.encode() for t in added.values()] if self.by_words else blank  # a cut may fall into these
        self.wide.sort(key=len, reverse=True)
        self.bytes_of = np.array(lengths, dtype=np.int64)  # a byte-level vocabulary has a sign per byte
        self.forget()

    def forget(self):
        self.names = np.zeros(0, np.uint64)  # hashes of known pieces, sorted
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    @staticmethod
    def cuts(buf: np.ndarray, offsets: np.ndarray, by_words: bool = False) -> np.ndarray:
        """Starts of pieces: row starts, and blanks after a visible character.
        Characters of two bytes from C3 on are visible, as is ASCII from 0x21;
        others may be blank, and no cut is made after them. ``by_words`` also
        cuts between an ASCII letter and an ASCII sign."""
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        if n > 1:
            seen = buf - np.uint8(0x21) < 0x7F - 0x21
            last, visible = buf[:-1], seen[:-1].copy()
            if (buf > 0x7F).any():
                lead = np.zeros(n - 1, np.uint8)
                lead[1:] = buf[:-2]
                visible |= (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
            blank = buf[1:] - np.uint8(0x09) < 5
            blank |= buf[1:] == 0x20
            np.logical_and(blank, visible, out=cut[1:n])
            if by_words:
                letter = (buf | np.uint8(0x20)) - np.uint8(0x61) < 26
                cut[1:n] |= letter[:-1] & (seen & ~letter & (buf - np.uint8(0x30) > 9))[1:]
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def _around_added(self, start: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The cuts but those inside an added token or at its end; row starts stay."""
        raw = buf.tobytes()
        here = [x for x in self.wide if x in raw]
        if not here:
            return start
        whole = np.zeros(len(buf) + 1, dtype=bool)
        for m in re.finditer(b"(?=(" + b"|".join(map(re.escape, here)) + b"))", raw):
            whole[m.start() + 1:m.end(1) + 1] = True
        whole[offsets] = False
        return start[~whole[start]]

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the ids, number of ids) of new pieces."""
        first, last = np.frombuffer(raw, np.uint8)[start], np.frombuffer(raw, np.uint8)[end - 1]
        word = np.zeros(len(start), dtype=bool)
        if self.by_words:  # these are one word to the tokenizer, so its model takes them as they are
            other = np.concatenate([[0], np.cumsum(~_LETTER[np.frombuffer(raw, np.uint8)])])
            bare = start + (first == 0x20)
            word = (bare < end) & (other[end] == other[bare])
        plain = ~word & _BLANK[first] & (last > 0x20) & (last < 0x7F) & self.beside  # may stand side by side
        found = [np.zeros(0, self.dtype)]
        count = np.zeros(len(start), np.int64)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(plain), np.flatnonzero(~word & ~plain)])
        i = np.flatnonzero(word)
        if len(i):
            text, tokenize = raw.decode("latin-1").replace(" ", "\u0120"), self.tokenizer.model.tokenize
            each = [[t.id for t in tokenize(text[s:e])] for s, e in zip(start[i].tolist(), end[i].tolist())]
            count[i] = list(map(len, each))
            found.append(np.fromiter(chain.from_iterable(each), self.dtype))
        i = np.flatnonzero(plain)
        if len(i):
            joined = b"".join([raw[s:e] for s, e in zip(start[i].tolist(), end[i].tolist())]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.cumsum(self.bytes_of[ids])
            upto = np.searchsorted(ends, np.cumsum(end[i] - start[i])) + 1
            if not (ends[upto - 1] == np.cumsum(end[i] - start[i])).all():
                raise ValueError("the tokenizer joins pieces; it can't be used by pieces")
            count[i] = np.diff(upto, prepend=0)
            found.append(ids)
        i = np.flatnonzero(~word & ~plain)
        if len(i):
            each = self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in zip(start[i], end[i])], add_special_tokens=False)
            count[i] = [len(x.ids) for x in each]
            found.append(np.array([t for x in each for t in x.ids], dtype=self.dtype))
        ids = np.concatenate(found)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order] + len(self.ids)
        self.ids = np.append(self.ids, ids)
        return begin, count

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids in each row)."""
        start = self.cuts(buf, offsets, self.by_words)
        if self.wide:
            start = self._around_added(start, buf, offsets)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf))), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        at = self._places(*text_buffer(each.dictionary))
        count = self.count[at]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.start[at] - upto[:-1], count) + np.arange(upto[-1])]
        width = self.dtype.itemsize
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(upto * width), pa.py_buffer(ids)]).take(each.indices)
        ids = np.frombuffer(coded.buffers()[2], self.dtype)
        upto = np.frombuffer(coded.buffers()[1], np.int64, len(start) + 1) // width
        return ids[:upto[-1]], np.diff(upto[np.searchsorted(start, offsets)])

    def _places(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where each of these distinct pieces stands among the known ones; new ones are learnt."""
        start, end = offsets[:-1], offsets[1:]
        name = A.of_runs(A.codes[buf], start, end) ^ (end - start).astype(np.uint64)
        order = np.argsort(name)
        name = name[order]
        if len(self.names) > KNOWN_PIECES or len(self.ids) > KNOWN_IDS:
            self.forget()
        at = np.searchsorted(self.names, name)
        new = np.ones(len(name), dtype=bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != name[inside]
        if new.any():
            begin, count = self._learn(buf.tobytes(), start[order[new]], end[order[new]])
            self.names, self.start, self.count = (np.insert(old, at[new], x) for old, x in ((self.names, name[new]), (self.start, begin), (self.count, count)))
            at = np.searchsorted(self.names, name)
        out = np.empty_like(at)
        out[order] = at
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_json: str) -> PieceEncoder:
    """One encoder per Python worker, so that its tasks share what it knows."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = PieceEncoder(tokenizer_json, special_as_text=False)
    return _ENCODERS[tokenizer_json]


def token_ids(batches: Iterator[pa.RecordBatch], encoder: PieceEncoder, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(documents, ids in each, ids) of runs of rows (id, text); each whole text's ids and the end id."""
    for rows, buf, offsets in pieces(batches, "text", SLAB_BYTES):
        ids, count = encoder.encode(buf, offsets)
        yield rows.column("id").to_pylist(), count + 1, np.insert(ids, np.cumsum(count), end_id)


def pack_group(documents: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    index = zstandard.ZstdCompressor(level=3).compress(documents.astype("<i8").tobytes() + counts.astype("<u4").tobytes())
    blocks = encode(ids, vocabulary)
    body = _HEAD.pack(_MAGIC, len(documents), len(blocks), vocabulary, len(index), len(ids)) + index + b"".join(_BLOCK.pack(n, crc, len(w)) for n, crc, w in blocks)
    body += struct.pack("<I", zlib.crc32(body)) + b"".join(w for _, _, w in blocks)
    return struct.pack("<Q", len(body)) + body


def unpack_groups(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, ids of each in this group, ids) of each group of a file."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<Q", data, at)[0]
        body = memoryview(data)[at + 8:at + 8 + size]
        if len(body) != size or bytes(body[:4]) != _MAGIC:
            raise ValueError("not a whole token file")
        _, n_docs, n_blocks, vocabulary, n_index, n_ids = _HEAD.unpack_from(body)
        table = _HEAD.size + n_index
        words = table + n_blocks * _BLOCK.size + 4
        if zlib.crc32(body[:words - 4]) != struct.unpack_from("<I", body, words - 4)[0]:
            raise ValueError("wrong checksum in a group's head")
        index = zstandard.ZstdDecompressor().decompress(bytes(body[_HEAD.size:table]))
        blocks = []
        for i in range(n_blocks):
            n, crc, length = _BLOCK.unpack_from(body, table + i * _BLOCK.size)
            blocks.append((n, crc, bytes(body[words:words + length])))
            words += length
        ids = decode(blocks, vocabulary)
        if len(ids) != n_ids:
            raise ValueError("a group has lost ids")
        yield np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<u4", n_docs, 8 * n_docs).astype(np.int64), ids
        at += 8 + size + 1  # the sink ends a row with a newline


def _write(tokenizer, end_id: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, counts, held, n = [], [], [], 0

        def group():
            return pa.RecordBatch.from_arrays([pa.array([pack_group(np.array(documents), np.array(counts), np.concatenate(held), vocabulary)], pa.binary())], names=["value"])

        for names, sizes, ids in token_ids(batches, _encoder(tokenizer.value), end_id):
            at = 0
            for document, size in zip(names, sizes.tolist()):
                while size:
                    m = min(size, GROUP_IDS - n)
                    size -= m
                    documents.append(document)
                    counts.append(m | (size > 0) << 31)  # the last bit: it goes on in the next group
                    held.append(ids[at:at + m])
                    at, n = at + m, n + m
                    if n == GROUP_IDS:
                        yield group()
                        documents, counts, held, n = [], [], [], 0
        if n:
            yield group()

    return run


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of all rows of ``df`` under ``path``."""
    from tokenizers import Tokenizer
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    if vocabulary > 1 << 16:
        raise ValueError("the coder takes vocabularies of at most 65536 ids")
    files = max(1, -(-text_bytes(df, text_col) // FILE_BYTES))
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; executors get its content
        tokenizer = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "id", "text_hash").sortWithinPartitions("id", "text_hash").select("id", "text")
    groups = rows.mapInArrow(_write(tokenizer, end_id, vocabulary), "value binary")
    groups.select(F.col("value").cast("string").alias("value")).write.mode("errorifexists").text(path)


_DOCUMENTS = "file string, id long, place long, n_tokens long, crc long, ids binary"


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, place, n, crc, kept = [], 0, 0, 0, []
                for documents, counts, ids in unpack_groups(data.as_py()):
                    raw = ids.astype("<u4").tobytes()
                    at = 0
                    for document, count in zip(documents.tolist(), counts.tolist()):
                        m = count & 0x7FFFFFFF
                        part = raw[4 * at:4 * (at + m)]
                        crc, n, at = zlib.crc32(part, crc), n + m, at + m
                        if with_ids:
                            kept.append(part)
                        if not count >> 31:
                            out.append((name, document, place, n, crc, b"".join(kept) if with_ids else None))
                            place, n, crc, kept = place + n, 0, 0, []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_READ_NAMES)
                        out = []

    return run


_READ_NAMES = ["file", "id", "place", "n_tokens", "crc", "ids"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``file``, ``place`` (its first id's place in
    the file), ``n_tokens``, ``crc`` and ``ids`` (little-endian 32-bit integers)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_read(with_ids), _DOCUMENTS)
    return rows.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def with_starts(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` with ``start``: ids of all documents before, in ascending id
    order. Files are ordered by their first document (one row a file)."""
    files = documents.groupBy("file").agg(F.min(F.coalesce(F.col(id_col), F.lit(NO_ID))).alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return documents.join(files, "file").withColumn("start", F.col("before") + F.col("place")).drop("before")
