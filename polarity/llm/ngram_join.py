"""Exact Jaccard self-join on word shingles, and the groups its links form.

Adaptive multi-match prefixes. All shingles are ordered by how many rows hold
them (rarest first). Two sets with Jaccard similarity of at least t share at
least ``ceil(t * n)`` shingles for either size n, so for every l they share at
least l of their first ``n - ceil(t * n) + l`` ones. Each row picks the l whose
prefix promises the least work by its estimated candidates (postings of the
prefix, and those over l for verification); a pair must share at least the
smaller l of its two rows before it is verified.

Shingle counts cover all rows. Their hashes travel packed by (chunk, bucket),
a shingle that several rows of a chunk hold only once, so a shingle of a third
of all rows costs its bucket one entry a chunk. Only counts of shared shingles
come back, and since an intersection holds shared shingles only, rows are
verified without their texts.

Equal sets are one representative. The holders of a prefix shingle are first
verified against the smallest of them (a star, as many pairs as postings);
pairs that are linked by then need no check of their own, and only pairs from
different groups are matched and verified. A shingle that ``HOT`` or more
representatives hold gets an exact way of its own: its near holders are compared
by their difference to what most of them hold (see ``_delta_join``), so that a
large group of near copies never forms its pairs.

Rows without words have no shingles and no links; rows of 1 to 4 words have
their whole sequence as the one shingle. Rows of one id are one node. A null
id is one node, smaller than the others. Only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarity.llm.components import connected_components
from polarity.llm.scratch import lean, lean_group, materialise, text_bytes
from polarity.llm.words import NOT_BLANK, U, A, Words, grams, inside_rows, mix, pieces

SHINGLE = 5
NO_ID = -(1 << 63)
CHUNK_SHINGLES = 1_000_000
PIECE = 1 << 17              # text bytes that are hashed at once
CHUNK_ROWS = 60_000          # row places of a chunk fit 16 bits
BUCKET_SHINGLES = 1_500_000  # that a bucket counts on average
LONGEST = 8                  # largest l a row may choose
VERIFY = 8                   # cost of verifying a pair, in postings
HOT = 16                     # holders from which a shingle's holders are compared by difference
_MANY = 0xFFFF


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles, sorted by row and hash."""
    h = words.hashes()
    start, row = inside_rows(words, n)
    found = [(grams(h, n)[start] if len(start) else h[:0], row)]
    for m in range(1, n):
        short = np.flatnonzero(words.counts == m)
        if len(short):
            found.append((mix(grams(h, m)[words.first[short]] + U(m)), short))
    t, row = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((t, row))
    t, row = t[order], row[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
    return t[new], row[new]


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _six(x: np.ndarray) -> bytes:
    return (x & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> U(32)).astype(np.uint16).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << U(32)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("single", pa.binary()), ("rows", pa.binary()), ("many", pa.binary()), ("counts", pa.binary()), ("head", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("tokens", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("head", pa.binary())])


def _send(bits: int, n: int):
    mask = U((1 << bits) - 1)

    def emit(chunk, name):
        ids, sizes, digests, tokens = (np.concatenate(c) for c in zip(*chunk))
        chunk.clear()
        row = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
        tokens = tokens & U((1 << (48 + bits)) - 1)
        order = np.argsort(tokens, kind="stable")
        tokens, row = tokens[order], row[order]
        del order
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(tokens)))
        several = count > 1
        many, many_count = tokens[begin[several]], count[several]
        head = {"ids": ids, "sizes": sizes, "digests": digests, "many": many, "many_count": many_count.astype(np.uint16),
                "many_rows": row[np.repeat(several, count)] if len(begin) else row}
        rows = [(name % (1 << bits), name, None, None, None, None, _zip(pickle.dumps(head)))]
        single, where = tokens[begin[~several]], row[begin[~several]]
        del head, tokens, row, begin, count, several
        order = np.lexsort((where, single & mask))
        single, where = single[order], where[order]
        del order
        many_order = np.argsort(many & mask, kind="stable")
        many, many_count = many[many_order], many_count[many_order]
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        cut, many_cut = np.searchsorted(single & mask, edges), np.searchsorted(many & mask, edges)
        for b in range(1 << bits):
            s, m = slice(cut[b], cut[b + 1]), slice(many_cut[b], many_cut[b + 1])
            if cut[b + 1] > cut[b] or many_cut[b + 1] > many_cut[b]:
                steps = np.diff(where[s], prepend=np.uint16(0)).astype(np.uint16)
                rows.append((b, name, _six(single[s] >> U(bits)), _zip(steps.tobytes()), _six(many[m] >> U(bits)), many_count[m].astype(np.uint16).tobytes(), None))
            if len(rows) >= 256:
                yield _rows(rows, _SENT)
                rows = []
        if rows:
            yield _rows(rows, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        chunk, held, docs = [], 0, 0
        for rows, buf, offsets in pieces(batches, "text", PIECE):
            for at in range(0, rows.num_rows, CHUNK_ROWS):
                part = rows.slice(at, CHUNK_ROWS)
                o = offsets[at:at + part.num_rows + 1]
                words = Words(buf[o[0]:o[-1]], o - o[0], NOT_BLANK, lower=True)
                t, row = shingles(words, n)
                sizes = np.bincount(row, minlength=part.num_rows)
                sums = np.zeros((2, len(t) + 1), dtype=np.uint64)
                np.cumsum(mix(t), out=sums[0, 1:])
                np.cumsum(mix(t ^ U(0x5851F42D4C957F2D)) * U(0x2545F4914F6CDD1D), out=sums[1, 1:])
                edge = np.concatenate([[0], np.cumsum(sizes)])
                digests = (sums[:, edge[1:]] - sums[:, edge[:-1]]).T
                if docs + part.num_rows > CHUNK_ROWS:
                    yield from emit(chunk, name)
                    chunk, held, docs, name = [], 0, 0, name + 1
                chunk.append((part.column("id").to_numpy(), sizes, digests, t))
                held, docs = held + len(t), docs + part.num_rows
                if held >= CHUNK_SHINGLES:
                    yield from emit(chunk, name)
                    chunk, held, docs, name = [], 0, 0, name + 1
        if chunk:
            yield from emit(chunk, name)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _count(bits: int):
    """Rows that hold each shingle of a bucket; those of two or more go back to their chunks."""
    def run(table: pa.Table) -> pa.Table:
        out, tokens, rows, weight, source, chunks = [], [], [], [], [], []
        for r in table.to_pylist():
            if r["head"] is not None:
                out.append((r["chunk"], None, None, None, r["head"]))
                continue
            single, many = _from_six(r["single"]), _from_six(r["many"])
            tokens += [single << U(bits) | U(r["bucket"]), many << U(bits) | U(r["bucket"])]
            rows += [np.cumsum(np.frombuffer(_unzip(r["rows"]), np.uint16), dtype=np.uint16), np.full(len(many), _MANY, np.uint16)]
            weight += [np.ones(len(single), np.int64), np.frombuffer(r["counts"], np.uint16).astype(np.int64)]
            source.append(len(single) + len(many))
            chunks.append(r["chunk"])
        if tokens:
            t, rows, weight = np.concatenate(tokens), np.concatenate(rows), np.concatenate(weight)
            order = np.argsort(t, kind="stable")
            new = np.concatenate([[True], t[order][1:] != t[order][:-1]])
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=weight[order]).astype(np.int64)
            count = np.zeros(len(t), dtype=np.int64)
            count[order] = total[group]
            edge = np.concatenate([[0], np.cumsum(source)])
            for i, c in enumerate(chunks):
                s = slice(edge[i], edge[i + 1])
                k = count[s] > 1
                if k.any():
                    out.append((c, t[s][k].tobytes(), _zip(rows[s][k].tobytes()), _zip(np.minimum(count[s][k], 2**32 - 1).astype(np.uint32).tobytes()), None))
        return pa.Table.from_batches([_rows(out, _BACK)]) if out else _BACK.empty_table()

    return run


_SETS = "id long, n int, digest_a long, digest_b long, shared array<long>, n_prefix int, l int"
_SETS_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("shared", pa.list_(pa.int64())), ("n_prefix", pa.int32()), ("l", pa.int32())])


def _prefixes(percent: int):
    def run(table: pa.Table) -> pa.Table:
        tokens, rows, counts = [], [], []
        for r in table.to_pylist():
            if r["head"] is not None:
                head = pickle.loads(_unzip(r["head"]))
            else:
                tokens.append(np.frombuffer(r["tokens"], np.uint64))
                rows.append(np.frombuffer(_unzip(r["rows"]), np.uint16).astype(np.int64))
                counts.append(np.frombuffer(_unzip(r["counts"]), np.uint32).astype(np.int64))
        sizes = head["sizes"]
        if tokens:
            t, row, df = np.concatenate(tokens), np.concatenate(rows), np.concatenate(counts)
            one = row != _MANY
            many_t, many_df = t[~one], df[~one]
            order = np.argsort(many_t)
            place = order[np.searchsorted(many_t[order], head["many"])] if len(many_t) else np.zeros(0, np.int64)
            repeat = head["many_count"].astype(np.int64)
            t = np.concatenate([t[one], np.repeat(head["many"], repeat)])
            row = np.concatenate([row[one], head["many_rows"].astype(np.int64)])
            df = np.concatenate([df[one], np.repeat(many_df[place], repeat)])
            order = np.lexsort((t, df, row))
            t, row, df = t[order], row[order], df[order]
        else:
            t, row, df = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        shared = np.bincount(row, minlength=len(sizes))
        alone = sizes - shared
        least = -(-percent * sizes // 100)
        start = np.concatenate([[0], np.cumsum(shared)])
        cost = np.concatenate([[0], np.cumsum(df - 1)]).astype(np.float64)
        best, choice, length = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        for l in range(1, LONGEST + 1):
            m = np.clip(sizes - least + l - alone, 0, shared)
            postings = cost[start[:-1] + m] - cost[start[:-1]]
            work = np.where(l <= np.maximum(least, 1), postings * (1 + VERIFY / l), np.inf)
            better = work < best
            best, choice, length = np.where(better, work, best), np.where(better, l, choice), np.where(better, m, length)
        alive = (alone < sizes - least + 1) & (shared > 0)
        values = t[np.repeat(alive, shared)].view(np.int64)
        edges = np.concatenate([[0], np.cumsum(np.where(alive, shared, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(values), mask=pa.array(~alive))
        d = head["digests"].view(np.int64)
        return pa.table([pa.array(head["ids"]), pa.array(sizes.astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), lists,
                         pa.array(length.astype(np.int32)), pa.array(choice.astype(np.int32))], schema=_SETS_ARROW)

    return run


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, ``n`` (set size), a 128-bit digest of the
    set, and for rows that may have a partner ``shared`` (their shingles that
    other rows hold too, rarest first), ``n_prefix`` of which are the prefix
    that needs ``l`` matches."""
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(df, text_col) // 6 // BUCKET_SHINGLES, 1)
    bits = (buckets - 1).bit_length()
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(lean(_send(bits, n)), "bucket int, chunk long, single binary, rows binary, many binary, counts binary, head binary")
    back = sent.groupBy("bucket").applyInArrow(lean_group(_count(bits)), "chunk long, tokens binary, rows binary, counts binary, head binary")
    return back.groupBy("chunk").applyInArrow(lean_group(_prefixes(percent)), _SETS)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives with both sizes and the size of their intersection."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("shared_b"))
    return pairs.join(b, "b").join(a, "a").withColumn("both", F.size(F.array_intersect("shared_a", "shared_b"))).drop("shared_a", "shared_b")


def _similar(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _possible(percent: int) -> Column:
    """Bound by sizes: no more can be common than the smaller number of shingles that any other row holds."""
    return (100 + percent) * F.least("s_a", "s_b") >= percent * (F.col("n_a") + F.col("n_b"))


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """Columns of one side of a self-join."""
    return rows.select("token", *(F.col(c).alias(f"{new}{side}") for c, new in (("rep", ""), ("n", "n_"), ("s", "s_"), ("l", "l_"), ("g", "g_"))),
                       *(F.col(c).alias(f"{c}_{side}") for c in more))


def _delta_join(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sure links, candidate pairs) among the ``members`` (p, rep, g) of each
    group p, for groups whose sets are mostly alike.

    Let C be the shingles that most members hold and D = set xor C. Then
    ``|a xor b| = |D_a| + |D_b| - 2 |D_a & D_b|``, so with t percent and
    ``r = (100 + t) |D| - (100 - t) n`` two members are linked exactly if
    ``|D_a & D_b| >= (r_a + r_b) / (2 (100 + t))``. A member whose r is no more
    than the negated smallest r is linked to that innermost member. The others
    (outer) are joined, with each other and with the inner ones, on prefixes of
    their D's, rarest first: what nearly all members hold is in no D, so the
    pairs of a large group of near copies are never formed.
    """
    t = 100 + percent
    have = members.join(sets.select("rep", "n", "shared"), "rep")
    # tables of one row per group are written first, so that Spark can deal the rows of a hot group in the joins with them
    size = materialise(members.groupBy("p").agg(F.count("*").alias("k")))
    common = (have.select("p", F.explode("shared").alias("token")).groupBy("p", "token").agg(F.count("*").alias("c"))
              .join(size, "p").filter(2 * F.col("c") > F.col("k")).groupBy("p").agg(F.collect_list("token").alias("core")))
    common = materialise(common)
    core = F.coalesce("core", F.array().cast("array<long>"))
    delta = F.concat(F.array_except("shared", core), F.array_except(core, F.col("shared")))
    alone = F.col("n") - F.size("shared")
    rows = (have.join(common, "p", "left").select("p", "rep", "g", "n", alone.alias("alone"), delta.alias("delta"))
            .withColumn("d", F.size("delta") + F.col("alone")).withColumn("r", t * F.col("d") - (100 - percent) * F.col("n")))
    rows = materialise(rows)
    inner = materialise(rows.groupBy("p").agg(F.min(F.struct("r", "rep", "g")).alias("m")))
    rows = rows.join(inner, "p").withColumn("out", F.col("r") + F.col("m.r") > 0)
    sure = rows.filter(~F.col("out") & (F.col("g") != F.col("m.g"))).select(F.col("rep").alias("a"), F.col("m.rep").alias("b"))
    least = materialise(rows.filter("out").groupBy("p").agg(F.min("r").alias("r_out")))
    rows = rows.join(least, "p")  # groups without outer members are settled
    need = lambda r: F.greatest(F.lit(1), F.ceil((F.col("r") + r) / (2 * t)))
    prefix = lambda r: F.col("d") - need(r) + 1 - F.col("alone")  # noqa: E731  its own shingles come first
    rows = rows.withColumn("with_out", prefix(F.col("r_out"))).withColumn("with_in", F.when(F.col("out"), prefix(F.col("m.r"))).otherwise(0))
    parts = rows.filter("with_out > 0 OR with_in > 0").select("p", "rep", "g", "out", "with_out", "with_in", F.explode("delta").alias("token"))
    seen = rows.select("p", F.explode("delta").alias("token")).groupBy("p", "token").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("p", "rep").orderBy("c", "token"))
    parts = parts.join(seen, ["p", "token"]).withColumn("place", place).filter(F.col("place") <= F.greatest("with_out", "with_in"))
    parts = materialise(parts.select("p", "token", "rep", "g", "out", (F.col("place") <= F.col("with_out")).alias("for_out"), (F.col("place") <= F.col("with_in")).alias("for_in")))
    a = parts.filter("out").select("p", "token", F.col("rep").alias("a"), F.col("g").alias("g_a"), F.col("for_out").alias("x"), F.col("for_in").alias("y"))
    b = parts.select("p", "token", F.col("rep").alias("b"), F.col("g").alias("g_b"), F.col("out").alias("out_b"), F.col("for_out").alias("z"))
    both_out = F.col("out_b") & F.col("x") & F.col("z") & (F.col("a") > F.col("b"))
    met = a.join(b, ["p", "token"]).filter((F.col("g_a") != F.col("g_b")) & (both_out | (~F.col("out_b") & F.col("y") & F.col("z"))))
    return sure, met.select("a", "b").distinct()


def linked_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles`` and ``component_id``,
    the smallest id that links of at least ``percent`` % similarity reach."""
    every = materialise(shingle_sets(df, id_col, text_col, n, percent))
    key = ["n", "digest_a", "digest_b"]
    sets = materialise(every.filter("shared IS NOT NULL").groupBy(*key).agg(
        F.min("id").alias("rep"), F.min_by(F.struct("shared", "n_prefix", "l"), "id").alias("s")).select("rep", "n", *key[1:], "s.*"))
    prefix = sets.select("rep", "n", F.size("shared").alias("s"), "l", F.explode(F.slice("shared", F.lit(1), F.col("n_prefix"))).alias("token"))
    # stars: everyone against the smallest holder of each shingle
    low = prefix.groupBy("token").agg(F.min(F.struct("rep", "n", "s")).alias("low"), F.count("*").alias("held")).filter("held > 1")
    star = (prefix.join(low, "token").select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col("low.rep").alias("b"),
                                             F.col("low.n").alias("n_b"), F.col("low.s").alias("s_b"), (F.col("held") >= HOT).alias("hot"))
            .filter(F.col("a") != F.col("b")).filter(F.col("hot") | _possible(percent)).groupBy("a", "b").agg(F.max("hot").alias("hot")))
    near = materialise(_measured(star, sets))
    links = near.filter(_similar(percent)).select("a", "b")
    group = materialise(connected_components(links))
    # the rest: pairs of different groups that meet in a shingle
    held = (prefix.join(low.select("token", F.col("low.rep").alias("p"), (F.col("held") >= HOT).alias("hot")), "token")
            .join(group, prefix.rep == group.node, "left").select("token", "p", "hot", "rep", "n", "s", "l", F.coalesce("component", "rep").alias("g")))
    mixed = held.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x != y").select("token")
    held = materialise(held.join(mixed, "token", "left_semi"))
    differ = F.col("g_a") != F.col("g_b")
    # few holders: pairs must share as many shingles as the smaller l of both
    cold = held.filter("NOT hot")
    few = (_side(cold, "a").join(_side(cold, "b"), "token").filter((F.col("a") > F.col("b")) & differ & _possible(percent))
           .groupBy("a", "b").agg(F.count("*").alias("m"), F.first(F.least("l_a", "l_b")).alias("l")).filter("m >= l").select("a", "b"))
    # many holders: by the smallest holder, near ones (half in common) in their difference to the group's
    # common set, far ones against all
    close = near.filter("hot AND 3 * both >= n_a + n_b").select(F.col("a").alias("rep"), F.col("b").alias("p"), F.lit(True).alias("near"))
    hot = held.filter("hot").join(close, ["rep", "p"], "left").withColumn("near", F.coalesce("near", F.col("rep") == F.col("p")))
    hot = materialise(hot)
    far = (_side(hot.filter("NOT near"), "a").join(_side(hot, "b", "near"), "token")
           .filter(differ & _possible(percent) & (F.col("near_b") | (F.col("a") > F.col("b")))).select("a", "b"))
    members = hot.filter("near").select("p", "rep", "g").distinct()
    split = members.groupBy("p").agg(F.min("g").alias("x"), F.max("g").alias("y")).filter("x != y").select("p")
    sure, met = _delta_join(members.join(split, "p", "left_semi"), sets, percent)
    rest = few.union(far.union(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()
    found = _measured(rest, sets).filter(_similar(percent)).select("a", "b").union(sure)
    member = every.filter("shared IS NOT NULL").join(sets.select("rep", *key), key).select("id", "rep").distinct()
    # an id whose rows have several sets links them
    several = member.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x != y").select("id", F.col("x").alias("b"))
    several = member.join(several, "id").filter("rep != b").select(F.col("rep").alias("a"), "b")
    links = links.union(found).union(several)
    whole = connected_components(links)
    named = (member.join(whole, F.col("rep") == F.col("node"), "left")
             .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
    out = every.select("id", F.col("n").cast("long").alias("n_shingles")).join(named, "id", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("id")).alias(id_col), "n_shingles", real(F.coalesce("component_id", "id")).alias("component_id"))
