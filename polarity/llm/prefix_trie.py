"""Prefix trie of conversations, screened by a count-min sketch.

A conversation's turns are put in order (turn, role, text; nulls first) and get
a position each. A prefix is known by a 128-bit digest, the exclusive or of
hashes of its (position, role, text) triples, so each turn's row finds its own
prefix from running values, and a conversation is never gathered in one place:
turns are dealt by ranges of (conversation, turn, ...), and what earlier ranges
hold of a conversation is added from a table of one row per range and conversation.

Screening: tasks count the digests of all prefixes in a count-min sketch (two
rows, counters that stop at 2), whose size follows the number of prefixes up to
``MOST_CELLS``. An estimate of one proves that a prefix is one conversation's
alone. Such a node needs no shuffle: its row is emitted where the turn is, with
one member and at most one child. Only prefixes that may be shared are shuffled,
to be grouped exactly. A full sketch screens less but never wrongly.

Sums over subtrees need no walk. The smallest member of a node owns it, and
owns what follows on its own path, from its depth ``own`` on. A leaf is owned by
the conversation that ends there, so a node's leaves are the members that own a
childless end; and a member repeats (saves) the turns between the node and
``own``. Both are sums over members.

Nodes with many ends (copies of one conversation) get the digest of their ids
from packed runs of sorted ids, streamed in order through one hash.

A null role or text is empty. Rows of equal turn are ordered by role and text;
repeated rows are separate turns. Rows without a conversation id belong to no
conversation and are left out. An empty table has no node. Further columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarity.llm.scratch import materialise, scratch_scope
from polarity.llm.words import U

LEAST_CELLS = 1 << 16
MOST_CELLS = 1 << 26    # 64 MB for each row of the sketch
SLICE = 1 << 20         # cells that are added up as one value
SKETCH_TASKS = 4096     # tasks that make a sketch each, at most
HOT_PARTS = 1000        # a parent of more than this part of all branches is joined by broadcast
RUN_IDS = 20_000        # ids of a packed run

_NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, role, text) with positions from 1, in bounded tasks also for a very long conversation."""
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    # ranges are cut by short keys; among rows that these tell not apart only whole texts may be dealt to several ranges
    start = [F.substring(c, 1, 32) for c in ("role", "text")]
    tie = F.when((F.length("role") <= 32) & (F.length("text") <= 32), F.monotonically_increasing_id()).otherwise((1 << 63) - 1)  # a longer text comes after its start
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"role_start": start[0], "text_start": start[1], "tie": tie})
    rows = rows.repartitionByRange(parts, "conv", "turn", "role_start", "text_start", "tie").withColumn("part", F.spark_partition_id())
    rows = materialise(rows.select("conv", "turn", "role", "text", "part"))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    sizes = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of a conversation that lies in several: fewer than two per range
    offsets = sizes.join(split, "conv", "left_semi").select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("pos", F.row_number().over(inside)).join(F.broadcast(offsets), ["conv", "part"], "left")
    return numbered.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")


def mixed_turns(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Turns of conversations that begin with the first ``heads`` (``most`` at
    most) turns of conversation ``base`` and go on with their own turns after as
    many; columns of (conv, pos, role, text), positions counted anew. Both are
    expressions of ``conv``. Conversations left without a turn have one row
    with a null position."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = materialise(convs.select("conv", base.alias("base"), heads.cast("long").alias("h")))
    first = turns.filter(F.col("pos") <= most).join(convs.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi")
    given = first.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("given")).withColumnRenamed("conv", "base")
    heads_of = convs.join(given, "base", "left").select("conv", "h", F.slice(F.coalesce("given", F.array().cast("array<struct<pos:bigint,role:string,text:string>>")), F.lit(1), F.col("h").cast("int")).alias("given"))
    heads_of = materialise(heads_of)
    short = heads_of.select("conv", "h", F.size("given").cast("long").alias("got"))
    own = turns.join(short, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "role", "text")
    lead = heads_of.select("conv", F.inline("given")).select("conv", "pos", "role", "text")
    bare = heads_of.select("conv", F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return lead.union(own).union(bare)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, chars, upto, last): each prefix by its digest, with
    that of the prefix before, the code points of its last text and of all its texts."""
    h = [F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (11, 12)]
    rows = turns.filter("pos IS NOT NULL").select("conv", "pos", h[0].alias("x"), h[1].alias("y"), F.length("text").cast("long").alias("chars"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartitionByRange(parts, "conv", "pos").withColumn("part", F.spark_partition_id()))
    sums = [F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("chars").alias("chars"), F.max("pos").alias("n")]
    of = rows.groupBy("conv", "part").agg(*sums)
    several = of.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    offsets = of.join(several, "conv", "left_semi").select("conv", "part", F.bit_xor("x").over(before).alias("x0"), F.bit_xor("y").over(before).alias("y0"),
                                                          F.sum("chars").over(before).alias("c0"), F.max("n").over(every).alias("n0"))
    rows = rows.join(F.broadcast(offsets), ["conv", "part"], "left")  # as bounded as in ordered_turns
    upto = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    a, b = (F.bit_xor(c).over(upto).bitwiseXOR(zero(F.col(f"{c}0"))) for c in "xy")
    rows = rows.select("conv", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"), "x", "y", "chars", (F.sum("chars").over(upto) + zero(F.col("c0"))).alias("upto"),
                       (F.col("pos") == F.coalesce("n0", F.max("pos").over(Window.partitionBy("conv", "part")))).alias("last"))
    return rows.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "chars", "upto", "last")


def _cells(part: pa.RecordBatch, size: int, names=("a", "b")) -> list[np.ndarray]:
    return [(part.column(c).to_numpy().view(np.uint64) & U(size - 1)).astype(np.int64) for c in names]


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, size), dtype=np.uint8)
        some = False
        for batch in batches:
            some = some or batch.num_rows > 0
            for line, cell in zip(sketch, _cells(batch, size)):
                cell, n = np.unique(cell, return_counts=True)
                line[cell] = np.minimum(line[cell] + np.minimum(n, 2), 2)
        if some:
            for line in range(2):
                for at in range(0, size, SLICE):
                    cells = sketch[line, at:at + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array([line * (size // min(SLICE, size)) + at // SLICE], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, cells in zip(batch.column("slice").to_pylist(), batch.column("cells")):
            cells = np.frombuffer(cells.as_buffer(), np.uint8)
            total[at] = np.minimum(total[at] + cells, 2) if at in total else cells
    for at, cells in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])


def sketch_of(prefixes: DataFrame) -> np.ndarray:
    """(2, cells) counts of the digests of all rows, up to 2 each; at most 128 MB reach the driver."""
    n = prefixes.count()
    size = min(max(1 << (4 * n).bit_length(), LEAST_CELLS), MOST_CELLS)
    slices = 2 * max(size // SLICE, 1)
    rows = prefixes.select("a", "b")
    rows = rows.coalesce(min(SKETCH_TASKS, max(rows.rdd.getNumPartitions(), 1)))
    found = rows.mapInArrow(_count(size), "slice int, cells binary").repartition(slices, "slice").mapInArrow(_add, "slice int, cells binary")
    out = np.zeros((2, size), dtype=np.uint8)
    flat = out.reshape(-1)
    for at, cells in zip(*found.toArrow().select(["slice", "cells"]).to_pydict().values()):
        begin = at * min(SLICE, size)
        flat[begin:begin + len(cells)] = np.frombuffer(cells, np.uint8)
    return out


def _screen(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        size = sketch.shape[1]
        for batch in batches:
            may = [sketch[0][x] + sketch[1][y] == 4 for x, y in (_cells(batch, size), _cells(batch, size, ("up_a", "up_b")))]
            root = batch.column("depth").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(may[0]), pa.array(may[1] | root)], names=[*names, "shared", "up_shared"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of a node as one string each."""
    out, node, ids, length = [], None, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "first", "ids"])

    for rows in batches:
        for a, b, conv in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "conv"))):
            if node != (a, b) or len(ids) >= RUN_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    length += len(ids)
                    if length >= RUN_IDS:
                        yield batch()
                        out, length = [], 0
                node, ids = (a, b), []
            ids.append(conv)
    if ids:
        out.append((*node, ids[0], ",".join(map(str, ids))))
    if out:
        yield batch()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the runs of each node, which follow each other in order."""
    node, state = None, None
    for rows in batches:
        out = []
        for a, b, ids in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if node == (a, b):
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends"])


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends): SHA-256 of the ids of each node's ends (rows of a, b, conv), ascending and comma-joined."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_packed, "a long, b long, first long, ids string")
    return runs.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digest, "a long, b long, ends string")


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, role, text; a null position
    only says that the conversation is there), one row each: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``."""
    spark = turns.sparkSession
    with scratch_scope(spark) as keep:
        turns = materialise(turns)
        rows = materialise(_prefixes(turns))
        shared = spark.sparkContext.broadcast(sketch_of(rows))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        rows = materialise(rows.mapInArrow(_screen(shared, rows.columns), f"{kinds}, shared boolean, up_shared boolean"))
        # tails: nodes that the sketch proves to be one conversation's
        some = materialise(rows.filter("shared"))
        node = ["a", "b"]
        groups = some.groupBy(*node).agg(F.min("conv").alias("owner"), F.first("depth").alias("depth"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"),
                                         F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end"))
        groups = materialise(groups)
        alone = rows.filter("NOT shared")
        branches = groups.filter("depth > 1").select("up_a", "up_b").union(alone.filter("up_shared AND depth > 1").select("up_a", "up_b"))
        children = materialise(branches.groupBy("up_a", "up_b").agg(F.count("*").alias("n_children")).toDF("a", "b", "n_children"))
        groups = materialise(groups.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
        # by conversation: where it begins to own nodes, and whether its end is a leaf that it owns
        first = groups.groupBy("owner").agg(F.min("depth").alias("own")).toDF("conv", "own")
        tail = alone.filter("up_shared").groupBy("conv").agg(F.min("depth").alias("tail"))
        leaf = groups.filter("n_children = 0 AND owner = end").select(F.col("owner").alias("conv"), F.lit(1).cast("long").alias("leaf"))
        every = turns.groupBy("conv").agg(F.max("pos").alias("n"))
        tails = rows.filter("last AND NOT shared").select("conv", F.lit(1).cast("long").alias("leaf"))
        facts = (every.join(first, "conv", "left").join(tail, "conv", "left").join(leaf.union(tails).groupBy("conv").agg(F.max("leaf").alias("leaf")), "conv", "left")
                 .select("conv", "n", F.coalesce(F.least("own", "tail"), F.col("n") + 1).alias("own"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))
        facts = materialise(facts)
        # what a conversation has in all prefixes that it doesn't own
        repeats = materialise(some.select(*node, "conv", "depth", "chars", "upto").join(facts.select("conv", "own", "leaf"), "conv"))
        upto = repeats.filter("depth < own").groupBy("conv").agg(F.max("upto").alias("repeated"))
        repeats = repeats.join(upto, "conv", "left")
        saves = F.when(F.col("depth") < F.col("own"), F.col("repeated") - F.col("upto") + F.col("chars")).otherwise(0)
        sums = repeats.groupBy(*node).agg(F.sum("leaf").alias("n_leaves"), F.sum(saves).alias("saved_tokens"))
        ends = _ends(some.filter("last").join(groups.filter("n_ends > 1").select(*node), node).select(*node, "conv"))
        sha = lambda c: F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)
        whole = materialise(groups.join(sums, node).join(ends, node, "left").withColumn("ends", F.coalesce("ends", sha(F.col("end")))))
        # parents: an owner of the parent too, else by the parent's digest; a parent of many branches is broadcast
        least = every.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
        opened = whole.select("owner", "depth", *node, "up_a", "up_b").union(alone.filter("up_shared").select("conv", "depth", *node, "up_a", "up_b"))
        opened = materialise(opened.filter("depth > 1"))
        total = opened.count()
        names = whole.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("parent"), "n_children")
        hot = names.filter(F.col("n_children") * HOT_PARTS > total).drop("n_children")  # fewer than HOT_PARTS rows
        found = opened.join(F.broadcast(hot), ["up_a", "up_b"], "left")
        cold = found.filter("parent IS NULL").drop("parent").join(names.drop("n_children"), ["up_a", "up_b"], "left")
        # a parent that wasn't shuffled is its child's owner's alone
        parents = found.filter("parent IS NOT NULL").select(*node, "parent").union(cold.select(*node, F.coalesce("parent", "owner")))
        up = F.when(F.col("depth") == 1, F.lit(least["root"])).otherwise(F.col("parent"))
        inner = whole.join(parents, node, "left").select(F.col("owner").alias("conv_id"), "depth", up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                                                         "saved_tokens", F.col("ends").alias("ends_sha256"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        outer = (alone.join(parents, node, "left").select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(least["root"])).when(F.col("up_shared"), F.col("parent"))
                 .otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                 none.alias("saved_tokens"), F.when(F.col("last"), sha(F.col("conv"))).otherwise(F.lit(_NONE)).alias("ends_sha256")))
        if not least["n"]:
            root = inner.limit(0)
        else:
            tops = groups.filter("depth = 1").count() + alone.filter("depth = 1").count()
            leaves = facts.agg(F.sum("leaf")).first()[0] if tops else 1
            saved = repeats.filter("depth < own").groupBy("conv").agg(F.max("upto").alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
            bare = every.filter("n IS NULL").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv")
            ends = _ends(bare).select("ends").collect()  # one row at most
            root = spark.createDataFrame([(least["root"], 0, None, least["n"], tops, int(leaves), int(saved), ends[0][0] if ends else _NONE)], inner.schema)
        out = keep(materialise(inner.union(outer).union(root)))
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    return out.select(*(F.col(c).cast("long") if kinds[c] != "string" else F.col(c) for c in _COLUMNS))
