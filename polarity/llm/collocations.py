"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are word pairs, edges are word triples: the edge (x, y, z) leads from node
(x, y) to node (y, z), and its weight is how often the triple occurs. Only the
longest grams are counted: each word of a piece sends the triple that begins
there, and the last two of a piece send what is left of it, so every word
occurrence is one entry. A node's count is its flow, the weights of its edges
plus the piece ends at it, a word's count the flow of its nodes plus the
pieces that end with it.

A map task counts the entries of a chunk, so that a copy, a common line or a
common pair costs its bucket one entry a chunk, and sends them as places in a
small dictionary of the bucket's words. An entry goes by its first word, so that
its bucket knows the flows whole. Words with too many entries for one bucket
are dealt by their nodes and such nodes by their edges (``HOT_WORDS`` at most,
estimated from one text in ``SAMPLE``, which only decides where entries go); their
flows are added up afterwards.

Unary paths are compacted: a node whose flow all comes from one edge and goes
to one edge adds nothing to what these say. Chains of such edges become one path
(first two words, then one word per edge) with one weight, found by pointer
doubling; a path is no longer than a piece. Counts inside a path are its weight;
only the nodes between paths need their own. Scores are exact: products are
decimals of 38 digits.

Texts are cut into pieces at . , ; : ! ? and line breaks and into words at blank and
tab, A-Z in lower case. Null and empty texts have no words; a null language is ``und``.
Repeated rows count each. Ties in the ranking go to the smaller phrase. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarity.llm.scratch import materialise, scratch_scope, text_bytes
from polarity.llm.words import U, Words, mix, pieces

CHUNK_WORDS = 1_000_000   # words that a map task counts before it sends them; fewer than 2**21
BUCKET_WORDS = 2_000_000  # word occurrences that a bucket gets on average
SAMPLE = 64
HOT_WORDS = 1_000_000
HOT_SHARE = 20            # a word is hot from this part of a bucket on
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAKS
_INSIDE[[0x20, 0x09]] = False

_EDGE, _NODE, _WORD, _NAME, _TOTAL = range(5)


def entries(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first, second, third): the hashes of each word and of the next two in its piece (0: none)."""
    words = Words(buf, offsets, _INSIDE, lower=True)
    h = words.hashes()
    h[h == 0] = 1  # 0 says that there is no word
    breaks = np.cumsum(_BREAKS[buf])[words.starts] if len(words) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    joined = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])  # with the next word
    second, third = np.zeros_like(h), np.zeros_like(h)
    second[:-1] = np.where(joined, h[1:], 0)
    third[:-1] = np.where(joined, second[1:], 0)
    return words, h, second, third


def _home(first, second, third, hot_words, hot_nodes, buckets: int) -> np.ndarray:
    """Bucket of each entry: by its first word, or for hot words its node, or for hot nodes the whole edge."""
    name = mix(first)
    many = np.isin(first, hot_words)
    node = mix(first * U(3) + mix(second))
    name = np.where(many, node, name)
    name = np.where(many & np.isin(node, hot_nodes), mix(node + mix(third + U(7))), name)
    return (name % U(buckets)).astype(np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("names", pa.binary())])


def _send(buckets: int, shared):
    zip_ = lambda b: zstandard.ZstdCompressor(level=1).compress(b)

    def emit(chunk):
        hot_words, hot_nodes = shared.value
        langs = np.concatenate([c[1] for c in chunk])
        first, second, third = (np.concatenate([c[k] for c in chunk]) for k in (2, 3, 4))
        vocabulary, index, place = np.unique(first, return_index=True, return_inverse=True)  # each word begins an entry
        words = np.concatenate([[U(0)], vocabulary])
        size = len(words)
        one = place + 1
        two, three = np.searchsorted(words, second), np.searchsorted(words, third)
        out = []
        for lang in np.unique(langs).tolist():
            own = np.flatnonzero(langs == lang)
            key, count = np.unique((one[own] * size + two[own]) * size + three[own], return_counts=True)
            i = np.stack([key // size // size, key // size % size, key % size])
            bucket = _home(words[i[0]], words[i[1]], words[i[2]], hot_words, hot_nodes, buckets)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                used, at = np.unique(i[:, part], return_inverse=True)
                at = at.reshape(3, -1).astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                out.append((int(bucket[part[0]]), lang, words[used].tobytes(), zip_(at.tobytes()), zip_(count[part].astype(np.uint32).tobytes()), None))
                if len(out) >= 256:
                    yield out
                    out = []
        # the words themselves, by their own hash
        edge = np.cumsum([0, *(len(c[2]) for c in chunk)])
        slab = np.searchsorted(edge, index, side="right") - 1
        raw = [c[0].buf.tobytes() for c in chunk]
        names = [raw[s][chunk[s][0].starts[k]:chunk[s][0].ends[k]] for s, k in zip(slab.tolist(), (index - edge[slab]).tolist())]
        bucket = (mix(vocabulary) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            out.append((int(bucket[part[0]]), None, vocabulary[part].tobytes(), None, None, zip_(b"\n".join(names[k] for k in part.tolist()))))
            if len(out) >= 256:
                yield out
                out = []
        if out:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for rows, buf, offsets in pieces(batches, "text"):
            words, *hashes = entries(buf, offsets)
            if not len(words):
                continue
            if held + len(words) > CHUNK_WORDS and chunk:
                for out in emit(chunk):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)
                chunk, held = [], 0
            lang = np.repeat(np.array(rows.column("lang").to_pylist(), dtype=object), words.counts)
            chunk.append((words, lang, *hashes))
            held += len(words)
        if chunk:
            for out in emit(chunk):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)

    return run


_FOUND = "kind int, lang string, x long, y long, z long, f long, word string"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("lang", pa.string()), *((c, pa.int64()) for c in "xyzf"), ("word", pa.string())])


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each key, sum of the key's weights)."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return order[begin], np.add.reduceat(weight[order], begin)


def _count(shared, least: int):
    """Edges, nodes and words of a bucket that occur ``least`` times or more, whatever of hot ones, and names."""
    unzip = lambda b: zstandard.ZstdDecompressor().decompress(b)

    def table(kind, n, lang, x=None, y=None, z=None, f=None, word=None):
        long = lambda c: pa.nulls(n, pa.int64()) if c is None else pa.array(c.view(np.int64))
        return pa.table([pa.array(np.full(n, kind, np.int32)), pa.array([lang] * n, pa.string()), long(x), long(y), long(z), long(f),
                         pa.nulls(n, pa.string()) if word is None else pa.array(word, pa.string())], schema=_FOUND_ARROW)

    def run(group: pa.Table) -> pa.Table:
        hot_words, hot_nodes = shared.value
        langs: dict[str, list] = {}
        names: dict[int, bytes] = {}
        for r in group.to_pylist():
            words = np.frombuffer(r["words"], np.uint64)
            if r["names"] is not None:
                names |= zip(words.tolist(), unzip(r["names"]).split(b"\n"))
                continue
            at = np.frombuffer(unzip(r["places"]), np.uint16 if len(words) <= 1 << 16 else np.uint32).reshape(3, -1)
            langs.setdefault(r["lang"], []).append((words[at], np.frombuffer(unzip(r["counts"]), np.uint32).astype(np.int64)))
        out = [_FOUND_ARROW.empty_table()]
        if names:
            out.append(table(_NAME, len(names), None, x=np.array(list(names), np.uint64), word=[w.decode() for w in names.values()]))
        for lang, found in langs.items():
            (x, y, z), f = np.concatenate([w for w, _ in found], axis=1), np.concatenate([c for _, c in found])
            out.append(table(_TOTAL, 1, lang, f=np.array([f.sum()])))
            node = mix(x * U(3) + mix(y))
            i, f = _sums(mix(node + mix(z + U(7))), f)
            x, y, z, node = x[i], y[i], z[i], node[i]
            some = (f >= least) & (z != 0)
            out.append(table(_EDGE, int(some.sum()), lang, x[some], y[some], z[some], f[some]))
            i, flow = _sums(node, f)
            some = (y[i] != 0) & ((flow >= least) | np.isin(node[i], hot_nodes))
            out.append(table(_NODE, int(some.sum()), lang, x[i][some], y[i][some], f=flow[some]))
            i, flow = _sums(x, f)
            some = (flow >= least) | np.isin(x[i], hot_words)
            out.append(table(_WORD, int(some.sum()), lang, x[i][some], f=flow[some]))
        return pa.concat_tables(out)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different entries of each first word and of each node in runs of texts."""
    for rows, buf, offsets in pieces(batches, "text", 1 << 22):
        _, x, y, z = entries(buf, offsets)
        node = mix(x * U(3) + mix(y))
        i = np.unique(mix(node + mix(z + U(7))), return_index=True)[1]
        w, n = np.unique(x[i], return_counts=True)
        v, k = np.unique(node[i], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(w), len(v)]).astype(np.int32)), pa.array(np.concatenate([w, v]).view(np.int64)),
                                          pa.array(np.concatenate([n, k]))], names=["kind", "name", "n"])


def _hot(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the nodes that are dealt apart."""
    found = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "kind int, name long, n long")
    found = materialise(found.groupBy("kind", "name").agg(F.sum("n").alias("n")))
    total = found.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = found.filter(F.col("n") > F.lit(max(total / min(HOT_SHARE * buckets, HOT_WORDS), 1))).toArrow()
    kind, name = some.column("kind").to_numpy(), some.column("name").to_numpy().astype(np.int64).view(np.uint64)
    return name[kind == 0], name[kind == 1]


def word_graph(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> dict[str, DataFrame]:
    """The graph's parts that occur ``least`` times or more: ``edges`` (lang, x, y, z, f), ``nodes``
    (lang, x, y, f), ``words`` (lang, x, f) by word hashes; ``names`` (x, word) of all words, and ``totals`` (lang, n)."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    context = df.sparkSession.sparkContext
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(df, text_col) // 6 // BUCKET_WORDS, 1)
    hot = context.broadcast(_hot(rows, buckets))
    sent = rows.mapInArrow(_send(buckets, hot), "bucket int, lang string, words binary, places binary, counts binary, names binary")
    found = materialise(sent.groupBy("bucket").applyInArrow(_count(hot, least), _FOUND))
    part = lambda kind: found.filter(F.col("kind") == kind)
    flows = lambda kind, *key: part(kind).groupBy("lang", *key).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return {"edges": part(_EDGE).select("lang", "x", "y", "z", "f"), "nodes": materialise(flows(_NODE, "x", "y")), "words": materialise(flows(_WORD, "x")),
            "names": part(_NAME).select("x", "word"), "totals": part(_TOTAL).groupBy("lang").agg(F.sum("f").alias("n"))}


def compact_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, words, f): the edges as unary paths. The words of a path of m edges are m + 2 hashes."""
    edges = materialise(edges.withColumn("e", F.monotonically_increasing_id()))
    full_in = edges.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "f", F.col("e").alias("before"))
    full_out = edges.select("lang", "x", "y", "f", "e")
    inner = nodes.join(full_in, ["lang", "x", "y", "f"]).join(full_out, ["lang", "x", "y", "f"]).select("e", "before")
    # a node of flow f has one edge of weight f on a side at most
    at = materialise(edges.select("e").join(inner, "e", "left").select("e", F.coalesce("before", "e").alias("head"), F.col("before").isNotNull().cast("long").alias("place")))
    moving = True
    while moving:
        step = at.select(F.col("e").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        at = materialise(at.join(step, "head").select("e", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        moving = not at.filter("moved").isEmpty()
    last = F.transform(F.sort_array(F.collect_list(F.struct("place", "z"))), lambda s: s["z"])
    of = edges.join(at.select("e", "head", "place"), "e")
    start = F.min_by(F.struct("x", "y"), "place")
    return of.groupBy("lang", "head").agg(start.alias("s"), last.alias("z"), F.first("f").alias("f")).select("lang", F.concat(F.array("s.x", "s.y"), "z").alias("words"), "f")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact up to counts of 16 digits."""
    big = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)).cast("decimal(31,0)"), (big(left) * big(right)).cast("decimal(31,0)"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covered: int = 50, first: int = 2000) -> DataFrame:
    """Per language the ``first`` phrases of two or three words by score: lang,
    rank, phrase, a, l, r, n and score. A phrase occurs ``least`` times or more;
    one inside a longer phrase that has ``covered`` % or more of its count is left out."""
    with scratch_scope(df.sparkSession) as keep:
        graph = word_graph(df, text_col, lang_col, least)
        nodes, words = graph["nodes"], graph["words"]
        paths = materialise(compact_paths(graph["edges"], nodes))
        # the triples of each path; a pair inside a path has the path's weight, others their flow
        windows = paths.select("lang", "f", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("k"))
        windows = materialise(windows.select("lang", F.col("f").alias("a"), F.get("words", F.col("k")).alias("x"), F.get("words", F.col("k") + 1).alias("y"), F.get("words", F.col("k") + 2).alias("z"),
                                             (F.col("k") > 0).alias("after"), (F.col("k") < F.size("words") - 3).alias("before")))
        one = lambda name, c: words.select("lang", F.col("x").alias(name), F.col("f").alias(c))
        two = lambda x, y, c: nodes.select("lang", F.col("x").alias(x), F.col("y").alias(y), F.col("f").alias(c))
        head = windows.filter("after").withColumn("xy", F.col("a")).unionByName(windows.filter("NOT after").join(two("x", "y", "xy"), ["lang", "x", "y"]))
        both = head.filter("before").withColumn("yz", F.col("a")).unionByName(head.filter("NOT before").join(two("y", "z", "yz"), ["lang", "y", "z"]))
        three = both.join(one("x", "fx"), ["lang", "x"]).join(one("z", "fz"), ["lang", "z"])
        cuts = [F.struct(_score(F.col("a"), F.col(p), F.col(q)).alias("score"), F.lit(k).alias("k"), F.col(p).alias("l"), F.col(q).alias("r")) for k, (p, q) in enumerate((("fx", "yz"), ("xy", "fz")))]
        three = three.select("lang", "x", "y", "z", "a", F.least(*cuts).alias("c"))
        # pairs between paths; those inside one are covered by triples of the same count
        longer = windows.filter("NOT after").select("lang", "x", "y", "a").union(windows.filter("NOT before").select("lang", "y", "z", "a")).groupBy("lang", "x", "y").agg(F.max("a").alias("most"))
        inside = windows.filter("after").select("lang", "x", "y").distinct()
        pairs = nodes.join(longer, ["lang", "x", "y"], "left").filter(f"most IS NULL OR 100 * most < {covered} * f")
        pairs = pairs.join(inside, ["lang", "x", "y"], "left_anti") if covered <= 100 else pairs
        pairs = pairs.select("lang", "x", "y", F.col("f").alias("a")).join(one("x", "fx"), ["lang", "x"]).join(one("y", "fy"), ["lang", "y"])
        pairs = pairs.select("lang", "x", "y", F.lit(None).cast("long").alias("z"), "a", F.struct(_score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"), F.lit(0).alias("k"), F.col("fx").alias("l"), F.col("fy").alias("r")).alias("c"))
        every = materialise(pairs.unionByName(three).select("lang", "x", "y", "z", "a", "c.l", "c.r", "c.score"))
        # the first ones with all ties at the end, then by their words
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        end = every.select("lang", "score", "a", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= first).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("end"))
        names = graph["names"]
        near = every.join(materialise(end), "lang").filter(F.struct("score", "a") >= F.col("end")).drop("end")
        for c in "xyz":
            near = near.join(names.select(F.col("x").alias(c), F.col("word").alias(f"w{c}")), c, "inner" if c != "z" else "left")
        near = near.withColumn("phrase", F.concat_ws(" ", "wx", "wy", "wz"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first).join(graph["totals"], "lang")
        return keep(materialise(top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")))
