"""Near-duplicate documents by minhash tables with tensored banding.

Every set of word shingles gets ``collections`` sub-signatures, each the minima
of ``rows`` hash functions folded into one value. A table key combines the
sub-signatures of a pair of collections, so 16 collections of 3 functions (48
minhashes a document) give the keys of 120 tables of 6 functions each, which
would take 720 minhashes one by one. Two sets meet in a table if two of their
sub-signatures agree; at a similarity of 85 % that fails for 6 pairs of a
million, above it for fewer (at 90 % for 4 of a hundred million).

A sub-signature that one set alone has can stand in no shared key, so keys are
only formed from those that two sets have: one shuffle of ``collections``
values a set, and a second one for the few sets that are left. Equal sets are
one representative, whatever their number.

Candidates are confirmed on the full sets. The holders of a key are first
compared with one of them (a star: as many pairs as holders), and once more with
another one. Keys whose holders are in one group by then need no more pairs. The
holders of the others are compared by their difference to what most of them
have, by an exact prefix filter on these differences, and only pairs of
different groups are verified. Pairs are dealt out in blocks;
a block gets each text that it needs once, and a set is made from its text there.

Words are runs of characters outside blank, tab and line breaks, A-Z in lower
case. Rows without words (null, empty, blank) have no set and no link; fewer
words than a shingle are one shingle. Rows of one id are one node. A null id is
one node, smaller than the others. Ties don't matter: a group's smallest id is
its name. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.components import connected_components
from polarity.llm.ngram_join import _delta_join, shingles
from polarity.llm.scratch import materialise, scratch_scope
from polarity.llm.words import NOT_BLANK, U, Words, mix, pieces

SHINGLE = 5
PERCENT = 85
COLLECTIONS = 16
ROWS = 3
BLOCK_PAIRS = 4000  # pairs that are verified side by side
NO_ID = -(1 << 63)

_SKETCH = "id long, text_hash long, n int, digest_a long, digest_b long, signatures array<long>"


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(85)
    return r.integers(0, 2**63, count, dtype=np.uint64), r.integers(1, 2**63, count, dtype=np.uint64) * U(2) + U(1)


def signatures(tokens: np.ndarray, sizes: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """(set, collection) sub-signatures of the sets that lie one after the other; none may be empty."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), collections), dtype=np.uint64)
    turn, factor = _functions(collections * rows)
    for k in range(collections * rows):
        least = np.minimum.reduceat((tokens ^ turn[k]) * factor[k], begin)
        out[:, k // rows] = mix(out[:, k // rows] + least + U(k))
    return out


def _sketch(n: int, collections: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in pieces(batches, "text"):
            t, row = shingles(Words(buf, offsets, NOT_BLANK, lower=True), n)
            size = np.bincount(row, minlength=part.num_rows)
            some = size > 0
            sums = np.zeros((2, len(t) + 1), dtype=np.uint64)
            np.cumsum(mix(t), out=sums[0, 1:])
            np.cumsum(mix(t ^ U(0x9E3779B97F4A7C15)) * U(0x2545F4914F6CDD1D), out=sums[1, 1:])
            edge = np.concatenate([[0], np.cumsum(size)])
            digests = (sums[:, edge[1:]] - sums[:, edge[:-1]]).view(np.int64)
            values = signatures(t, size[some], collections, rows) if some.any() else np.zeros((0, collections), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * collections)]).astype(np.int32)), pa.array(values.ravel().view(np.int64)), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(size.astype(np.int32)), pa.array(digests[0]), pa.array(digests[1]), lists],
                                             names=["id", "text_hash", "n", "digest_a", "digest_b", "signatures"])

    return run


def table_keys(sets: DataFrame, collections: int) -> DataFrame:
    """(key, rep): the tables' keys of sets that share two sub-signatures with others."""
    each = sets.select("rep", F.posexplode("signatures").alias("i", "value"))
    shared = materialise(each.groupBy("i", "value").agg(F.count("*").alias("held")).filter("held > 1").select("i", "value"))
    own = each.join(shared, ["i", "value"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("own"))
    first = F.explode(F.transform("own", lambda x, k: F.struct(x.alias("x"), (k + 2).alias("rest")))).alias("f")
    pairs = own.filter(F.size("own") > 1).select("rep", "own", first).select("rep", "f.x", F.explode(F.slice("own", F.col("f.rest"), F.lit(collections))).alias("y"))
    return pairs.select(F.xxhash64("x.i", "x.value", "y.i", "y.value").alias("key"), "rep")


def _linked(percent: int, both, a, b):
    return 100 * both >= percent * (a + b - both)


def _confirm(n: int, percent: int):
    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        place, tokens, at = {}, [], 0
        for part, buf, offsets in pieces(iter(texts.to_batches()), "text"):
            t, row = shingles(Words(buf, offsets, NOT_BLANK, lower=True), n)
            edge = np.searchsorted(row, np.arange(part.num_rows + 1)) + at
            place |= {r: (int(edge[k]), int(edge[k + 1])) for k, r in enumerate(part.column("rep").to_pylist())}
            tokens.append(t)
            at += len(t)
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = tokens[slice(*place[a])], tokens[slice(*place[b])]
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) >= percent * len(y):
                i = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if _linked(percent, int((y[i] == x).sum()), len(x), len(y)):
                    out.append((a, b))
        a, b = zip(*out) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of representatives whose full sets are similar; ``texts`` has (rep, text)."""
    pairs = materialise(pairs)
    blocks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // BLOCK_PAIRS))
    # rows in order of b, so that few texts go to each block; a hot b goes to several
    dealt = materialise(pairs.repartitionByRange(blocks, "b", "a").select(F.spark_partition_id().alias("block"), "a", "b"))
    need = dealt.select("block", F.explode(F.array("a", "b")).alias("rep")).distinct()
    sent = need.join(texts, "rep").select("block", "rep", "text")
    return sent.groupBy("block").cogroup(dealt.toDF("of", "a", "b").groupBy("of")).applyInArrow(_confirm(n, percent), "a long, b long")


def _star(held: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b): holders (key, rep, g) of a key with the one of them that
    comes first in an order by ``seed``, if they aren't in its group yet."""
    order = F.struct(F.xxhash64(F.lit(seed), "rep"), "rep", "g")
    centre = materialise(held.groupBy("key").agg(F.min(order).alias("c"), F.count("*").alias("k")).filter("k > 1").select("key", "c.rep", "c.g").toDF("key", "b", "gb"))
    return held.join(centre, "key").filter("rep != b AND g != gb").select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()


def _mixed(held: DataFrame, group: DataFrame) -> DataFrame:
    """(key, rep, g) of the keys whose holders are in more than one group."""
    named = held.select("key", "rep").join(group, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("g"))
    named = materialise(named)
    several = materialise(named.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x != y").select("key"))
    return materialise(named.join(several, "key"))


def _shingle_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in pieces(batches, "text"):
            t, row = shingles(Words(buf, offsets, NOT_BLANK, lower=True), n)
            edge = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("g"), pa.ListArray.from_arrays(pa.array(edge), pa.array(t.view(np.int64)))], names=["rep", "g", "shared"])

    return run


def _rest(mixed: DataFrame, texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sure links, pairs to confirm) among the holders (key, rep, g) of mixed
    keys, which are compared by their difference to what most holders of the keys
    of one smallest group have, so that a large group of near copies never forms its pairs."""
    centre = materialise(mixed.groupBy("key").agg(F.min("g").alias("p")))
    members = materialise(mixed.join(centre, "key").select("p", "rep", "g").distinct())
    sets = members.select("rep", "g").distinct().join(texts, "rep").select("rep", "g", "text").mapInArrow(_shingle_rows(n), "rep long, g long, shared array<long>")
    return _delta_join(members, materialise(sets.select("rep", F.size("shared").alias("n"), "shared")), percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT,
                    collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles``, ``component_id`` (the
    smallest id that links of ``percent`` % similarity or more reach) and
    ``kept`` (whether it bears that id)."""
    spark = df.sparkSession
    key = ["n", "digest_a", "digest_b"]
    with scratch_scope(spark) as keep:
        source = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        every = materialise(source.mapInArrow(_sketch(n, collections, rows), _SKETCH))
        some = every.filter("n > 0")
        sets = materialise(some.groupBy(*key).agg(F.min(F.struct("id", "text_hash")).alias("r"), F.first("signatures").alias("signatures"))
                           .select(F.monotonically_increasing_id().alias("rep"), "r.*", *key, "signatures"))
        held = materialise(table_keys(sets, collections))
        wanted = held.select("rep").distinct().join(sets.select("rep", "id", "text_hash"), "rep")
        texts = materialise(source.join(wanted, ["id", "text_hash"]).groupBy("rep").agg(F.first("text").alias("text")))
        # each step keeps its result only; its own tables and shuffles go
        with scratch_scope(spark) as step:
            links = step(materialise(confirmed(_star(held.withColumn("g", F.col("rep")), 1), texts, n, percent)))
        with scratch_scope(spark) as step:
            mixed = step(_mixed(held, connected_components(links)))
        with scratch_scope(spark) as step:
            links = step(materialise(links.union(confirmed(_star(mixed, 2), texts, n, percent))))
        with scratch_scope(spark) as step:
            mixed = step(_mixed(mixed, connected_components(links)))
        with scratch_scope(spark) as step:
            sure, met = _rest(mixed, texts, n, percent)
            links = step(materialise(links.union(sure).union(confirmed(met, texts, n, percent))))
        member = materialise(some.select("id", *key).distinct().join(sets.select("rep", *key), key).select("id", "rep"))
        several = member.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("y")).filter("b != y").select("id", "b")
        several = member.join(several, "id").select(F.col("rep").alias("a"), "b").filter("a != b")  # sets of one id
        group = connected_components(links.union(several))
        named = materialise(member.join(group, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("g")).distinct())
        least = named.groupBy("g").agg(F.min("id").alias("c"))
        out = keep(materialise(every.select("id", "n").join(named.join(least, "g").select("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("id")).alias(id_col), F.col("n").cast("long").alias("n_shingles"), real(F.col("c")).alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))
