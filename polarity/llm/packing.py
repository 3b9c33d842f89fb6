"""Conflict-constrained best-fit packing of documents into bins of tokens.

Documents longer than a bin are cut into full pieces, which take a bin each,
and a rest. Items are dealt to shards of bounded size by a hash of id and
piece, so copies and sources spread, and every shard is packed by itself:
longest first, each into the tightest bin that has room and no conflict. Open
bins are ordered by what is left in them and carry a bitmap of the sources and
one of the duplicate clusters they hold; the search moves on to the next larger
rest until a bin shares neither bit with the item. Without one, a bin is opened.

A null source or cluster conflicts with nothing. Documents of no tokens (null
or not positive) get one row without a bin. Repeated rows are separate items.
Ties are broken by id and piece. Only the named columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ITEMS = 2048  # on average


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, given in packing order."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    open_bins: dict[int, list[list]] = {}  # what is left -> [bin, source bits, cluster bits]
    lefts = 0                              # bit r is set while a bin has r left
    bins, out = 0, []
    for n, source, cluster in zip(lengths, sources, clusters):
        s = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        c = 0 if cluster is None else cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        left, found = n, None
        while found is None:
            above = lefts >> left
            if not above:
                break
            left += (above & -above).bit_length() - 1
            found = next((b for b in open_bins[left] if not b[1] & s and not b[2] & c), None)
            if found is None:
                left += 1
        if found is None:
            found, left = [bins, 0, 0], capacity
            bins += 1
        else:
            open_bins[left].remove(found)
            if not open_bins[left]:
                lefts &= ~(1 << left)
        out.append((found[0], capacity - left))
        found[1] |= s
        found[2] |= c
        rest = left - n
        if rest:
            open_bins.setdefault(rest, []).append(found)
            lefts |= 1 << rest
    return out


def _pack(capacity: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "id", "piece", "start"], ascending=[False, True, True, True], kind="stable", na_position="first")
        known = lambda c: [None if pd.isna(v) else v for v in shard[c]]
        places = best_fit(shard["n_tokens"].tolist(), known("source"), known("cluster"), capacity)
        base = int(shard["shard"].iloc[0]) << 32
        shard["bin_id"] = [base + b for b, _ in places]
        shard["bin_start"] = [o for _, o in places]
        return shard[["id", "piece", "start", "n_tokens", "bin_id", "bin_start"]]

    return run


def pack(df: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str | None = "source",
         cluster_col: str | None = "cluster", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, ``piece``, ``start`` (its first token in the
    document), ``n_tokens``, ``bin_id`` and ``bin_start`` (its place there).
    No bin holds more than ``capacity`` tokens, two documents of one source or
    two of one duplicate cluster."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    column = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n"),
                     column(source_col, "string").alias("source"), column(cluster_col, "string").alias("cluster"))
    # rows without an id are dealt by their place, others by what they are
    rows = rows.withColumn("tie", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)).cast("long"))))
    cut = cut.withColumn("start", F.col("piece") * capacity).withColumn("n_tokens", F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("n") - F.col("start"))))
    shards = max(1, -(-cut.count() // SHARD_ITEMS))
    some = cut.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("id", "piece", "n", "cluster", "tie"), F.lit(shards)))
    kind = "id long, piece long, start long, n_tokens long, bin_id long, bin_start long"
    packed = some.select("shard", "id", "piece", "start", "n_tokens", "source", "cluster").groupBy("shard").applyInPandas(_pack(capacity), kind)
    none = cut.filter("n_tokens = 0").select("id", "piece", "start", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_start"))
    return packed.union(none).withColumnRenamed("id", id_col)


def word_count(text: str) -> F.Column:
    """Blank-separated words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
