"""CSV with quoted line breaks, one file in many tasks (S3).

A task that gets a byte range of a file can't know whether it begins inside a
quoted field. So there are two passes over the physical lines of each range.
The first one follows each range from both states, outside and inside a
quoted field, and says for each how the range ends. These answers, one row a
range, are put together on the driver: a range's true state is what the ranges
before it make of the state of the file's begin. In the second pass each range
is cut into records from its true state and its whole records are parsed where
they are. A record that lies in several ranges is put together from the parts
that the first pass kept, one row of each range.

Quotes are doubled inside quoted fields. A quote that doesn't begin a field is
a plain character, and text behind a closing quote belongs to the field up to
the next comma, as Spark's own reader takes them. Lines end with a line feed,
with or without a carriage return before it; empty lines are passed over. A
field left open at a file's end goes on to the end, without a line break there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, if one is (``inside``) or isn't before it."""
    at = 0
    if not inside:
        at = 1 if line.startswith('"') else line.find(',"') + 2
        if not line.startswith('"') and at == 1:
            return False
    while True:
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(",", at + 1)
        if at < 0:
            return False
        if not line.startswith('"', at + 1):
            at = line.find(',"', at)
            if at < 0:
                return False
        at += 2


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, bool]]:
    """((file, begin), lines, whether the range begins here) of runs of lines."""
    last = None
    for batch in batches:
        files, begins = batch.column("file").to_pylist(), batch.column("begin").to_numpy()
        cut = [0, *(i for i in range(1, len(files)) if begins[i] != begins[i - 1] or files[i] != files[i - 1]), len(files)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a < b:
                key = (files[a], int(begins[a]))
                yield key, batch.column("value").slice(a, b - a), key != last
                last = key


def _states(lines: pa.Array, inside: bool) -> np.ndarray:
    """State before each line and behind the last one."""
    quoted = np.flatnonzero(np.asarray(pc.match_substring(lines, '"')))
    out = np.empty(len(lines) + 1, dtype=bool)
    at = 0
    for i, line in zip(quoted.tolist(), lines.take(pa.array(quoted)).to_pylist()):
        out[at:i + 1] = inside
        inside, at = ends_inside(line, inside), i + 1
    out[at:] = inside
    return out


_ENDS = "file string, begin long, inside0 boolean, inside1 boolean, starts0 long, starts1 long, head0 string, head1 string, tail1 string"


class _Follow:
    """What a range makes of one state."""

    def __init__(self, inside: bool):
        self.inside, self.starts = inside, 0
        self.tail: list[str] = []  # lines before the first record
        self.head: list[str] = []  # lines of a record that is still open

    def take(self, lines: pa.Array) -> None:
        state = _states(lines, self.inside)
        begin = np.flatnonzero(~state[:-1])
        first = int(begin[0]) if len(begin) else len(lines)
        if not self.starts:
            self.tail += lines.slice(0, first).to_pylist()
        elif self.inside:
            self.head += lines.slice(0, first).to_pylist()
        if len(begin):
            self.head = []
            if state[-1]:
                self.head = lines.slice(int(begin[-1])).to_pylist()
        self.starts += len(begin)
        self.inside = bool(state[-1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, out, into):
        text = lambda lines, some: "\n".join(lines) if some else None
        return pa.RecordBatch.from_pylist([{"file": key[0], "begin": key[1], "inside0": out.inside, "inside1": into.inside, "starts0": out.starts, "starts1": into.starts,
                                            "head0": text(out.head, out.inside and out.starts), "head1": text(into.head, into.inside and into.starts), "tail1": text(into.tail, True)}])

    held = None
    for key, lines, new in _ranges(batches):
        if new:
            if held:
                yield row(*held)
            held = (key, _Follow(False), _Follow(True))
        for follow in held[1:]:
            follow.take(lines)
    if held:
        yield row(*held)


def _records(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside_at = shared.value
        inside, open_, header = False, [], False

        def out(texts):
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())], names=["record"])

        for key, lines, new in _ranges(batches):
            if new:
                inside, open_, header = key in inside_at, None, key[1] == 0
            state = _states(lines, inside)
            begin = np.flatnonzero(~state[:-1])
            first = int(begin[0]) if len(begin) else len(lines)
            if open_ is not None and first:  # goes on from the batch before
                open_ += lines.slice(0, first).to_pylist()
            if len(begin):
                if open_:
                    yield out(["\n".join(open_)])
                open_ = None
                closed = begin if not state[-1] else begin[:-1]
                if state[-1]:
                    open_ = lines.slice(int(begin[-1])).to_pylist()
                edges = np.append(closed, begin[-1] if state[-1] else len(lines)).astype(np.int32)
                if len(closed):
                    if header:
                        edges, header = edges[1:], False
                    lists = pa.ListArray.from_arrays(pa.array(edges), lines)
                    yield out(pc.binary_join(lists, "\n"))
                elif header:  # it is open: passed over as it ends, or with the parts
                    open_, header = None, False
            elif open_ is not None and not state[-1]:
                yield out(["\n".join(open_)])
                open_ = None
            inside = bool(state[-1])

    return run


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | str, options: dict[str, str]) -> DataFrame:
    """Rows of the header CSV files under ``path``, each range of
    ``spark.sql.files.maxPartitionBytes`` a task of its own; ``options`` are those of ``from_csv``."""
    from polarity.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    ends = lines.mapInArrow(_ends, _ENDS).checkpoint()
    inside_at, owners, at = set(), [], None
    for r in ends.select("file", "begin", "inside0", "inside1", "starts1").orderBy("file", "begin").collect():  # one small row a range
        if at is None or at[0] != r["file"]:
            at = (r["file"], False, r["begin"])
        _, inside, owner = at
        if inside:
            inside_at.add((r["file"], r["begin"]))
        owners.append((r["file"], r["begin"], inside, owner))
        at = (r["file"], r["inside1"] if inside else r["inside0"], r["begin"] if not inside or r["starts1"] else owner)
    whole = lines.mapInArrow(_records(spark.sparkContext.broadcast(inside_at)), "record string")
    true = spark.createDataFrame(owners, "file string, begin long, inside boolean, owner long")
    parts = ends.join(true, ["file", "begin"])
    # the begin of a record that stays open, and what later ranges add to it
    head = F.when(F.col("inside"), F.col("head1")).otherwise(F.col("head0"))
    header = (F.col("begin") == 0) & (F.col("starts0") == 1)
    heads = parts.filter(head.isNotNull()).select("file", F.col("begin").alias("owner"), "begin", head.alias("text"), header.alias("header"))
    tails = parts.filter("inside").select("file", "owner", "begin", F.col("tail1").alias("text"), F.lit(False).alias("header"))
    joined = heads.union(tails).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("begin", "text"))).alias("parts"), F.max("header").alias("header"))
    joined = joined.filter("NOT header").select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record"))
    records = whole.union(joined).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record != ''")
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records.select(F.from_csv("record", kind, {**options, "multiLine": "true"}).alias("r")).select("r.*")
