"""T9 without a dictionary: lemmas by rules, confirmed by the corpus itself.

A rule takes an ending off a token and puts another one there. The rules lie in a
trie of reversed endings, so that a token is walked from its end once. A base
counts only if it is a word of the corpus; the rule with the longest ending
wins, then the earlier one. The table (token, lemma) of all tokens that change
comes from the corpus's distinct tokens: one aggregation and one join.

A table of any size is applied in the row: tokens are looked up in a broadcast
perfect hash, in several passes if the table is longer than ``PART_ENTRIES``. A
token that the table gives more than one lemma takes the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.perfect_hash import PerfectHash
from polarity.functions.word_runs import code_points, hashes_of, word_hashes

# Endings of English plurals and verb forms, and what takes their place.
RULES = (("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ies", "y"), ("men", "man"), ("s", ""),
         ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"))
# Fixed value: tokens that end so aren't plurals.
KEPT = ("ss", "us", "is")
LEAST_BASE = 2  # letters of a base
PART_ENTRIES = 4_000_000


def suffix_trie(rules: Sequence[tuple[str, str]]) -> dict:
    """Reversed endings, a letter a level; under "" the (rank, new ending) of the ending read so far."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))
    trie: dict = {}
    for rank, i in enumerate(order):
        node = trie
        for letter in reversed(rules[i][0]):
            node = node.setdefault(letter, {})
        node.setdefault("", []).append((rank, rules[i][1]))
    return trie


def bases(token: str, trie: dict) -> list[tuple[int, str]]:
    """(rank, base) of each rule that a token's end meets."""
    out, node = [], trie
    if token.endswith(KEPT):
        return out
    for at in range(len(token) - 1, -1, -1):
        node = node.get(token[at])
        if node is None:
            break
        out += [(rank, token[:at] + end) for rank, end in node.get("", ()) if len(token[:at] + end) >= LEAST_BASE]
    return out


def _candidates(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = suffix_trie(rules)
        for batch in batches:
            found = [(t, b, r) for t in batch.column("token").to_pylist() for r, b in bases(t, trie)]
            t, b, r = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(b, pa.string()), pa.array(r, pa.int32())], names=["token", "base", "rank"])

    return run


def rule_lemma_table(df: DataFrame, tokens: Column, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(token, lemma) of the tokens of ``df`` that a rule leads to another token of it."""
    from polarity.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    words = df.select(F.explode(tokens).alias("token")).filter("token IS NOT NULL").distinct().checkpoint()
    found = words.mapInArrow(_candidates(tuple(rules)), "token string, base string, rank int")
    held = found.join(words.withColumnRenamed("token", "base"), "base")
    return held.groupBy("token").agg(F.min_by("base", "rank").alias("lemma"))


def _replace(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phash, keys, lemmas = shared.value
        for rows in batches:
            tokens = rows.column("_tokens")
            edges = tokens.offsets.to_numpy()
            words = tokens.values.slice(edges[0], edges[-1] - edges[0])
            points, cut = code_points(words)
            hashes = word_hashes(points, cut[:-1], cut[1:])
            at = phash.find(hashes)
            known = (at >= 0) & (keys[at] == hashes) if len(keys) else np.zeros(len(hashes), bool)
            # a lemma where the token is known, else nothing, which the token itself fills
            words = pc.coalesce(lemmas.take(pa.array(np.where(known, at, 0), mask=~known)), words.cast(pa.string())) if len(keys) else words
            lists = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), lists], names=[*names, "_tokens"])

    return run


def replace_tokens(df: DataFrame, tokens: Column, table: DataFrame, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: the tokens with each replaced by its lemma in ``table`` (token, lemma); null gives none."""
    spark = df.sparkSession
    pairs = table.filter("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("lemma")).filter("token != lemma")
    parts = max(1, -(-pairs.count() // PART_ENTRIES))
    carried = [c for c in df.columns if c != out_col]
    names = [f"c{i}" for i in range(len(carried))]
    rows = df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(carried, names)), F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
    kind = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(names, carried)), T.StructField("_tokens", T.ArrayType(T.StringType()))])
    done = []
    for part in range(parts):
        own = pairs.filter(F.pmod(F.xxhash64("token"), F.lit(parts)) == part) if parts > 1 else pairs
        found = own.toArrow()
        hashes = hashes_of(found.column("token").to_pylist())
        phash = PerfectHash.build(np.unique(hashes))
        at = phash.find(hashes)
        order = np.argsort(at, kind="stable")
        done.append((phash, hashes[order], found.column("lemma").combine_chunks().cast(pa.string()).take(pa.array(order))))
    if len(done) == 1:
        rows = rows.mapInArrow(_replace(spark.sparkContext.broadcast(done[0]), names), kind)
    else:  # a lemma must not be replaced again by a later part, so each part sees the tokens as they were
        rows = rows.withColumn("_first", F.col("_tokens"))
        whole = T.StructType([*kind.fields[:-1], T.StructField("_first", kind.fields[-1].dataType), kind.fields[-1]])
        for arrays in done:
            before = rows.withColumnRenamed("_tokens", "_so_far").withColumn("_tokens", F.col("_first"))
            step = T.StructType([*whole.fields[:-1], T.StructField("_so_far", kind.fields[-1].dataType), kind.fields[-1]])
            before = before.select(*names, "_first", "_so_far", "_tokens").mapInArrow(_replace(spark.sparkContext.broadcast(arrays), [*names, "_first", "_so_far"]), step)
            changed = F.zip_with(F.arrays_zip(F.col("_so_far").alias("s"), F.col("_first").alias("f")), F.col("_tokens"), lambda a, t: F.when(t != a["f"], t).otherwise(a["s"]))
            rows = before.select(*names, "_first", changed.alias("_tokens"))
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, carried)), F.col("_tokens").alias(out_col))
