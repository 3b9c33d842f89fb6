"""Search for many terms at once (S7): an Aho-Corasick automaton over words.

Terms and texts are split into words by one rule (lower-case runs of letters and
digits). The automaton's states are the beginnings of terms; its arrays are a
sorted goto table ``state * words + word -> state``, the failure state of each
state, and per state the next one on its failure chain that ends a term. It is
built once on the driver and broadcast; a table of terms beyond
``AUTOMATON_BYTES`` becomes several automata, one pass over the texts each.

Texts are read as Arrow buffers. Words that no term holds split a text into
runs, and the automaton steps through all runs of a slab of texts side by side,
so the work is linear in the words of a text and in the hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.word_runs import code_points, letters_and_digits, slabs, word_bounds, word_hashes

AUTOMATON_BYTES = 64 << 20  # text of terms that go into one automaton
SLAB_BYTES = 1 << 18        # text that is searched at once


@dataclass
class Automaton:
    words: np.ndarray    # sorted hashes of the words of terms
    keys: np.ndarray     # sorted state * len(words) + word
    to: np.ndarray       # state of each key
    fail: np.ndarray
    ends: np.ndarray     # number of the term that ends at a state, or -1
    output: np.ndarray   # next state on the failure chain that ends a term, or 0

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after one more word each."""
        out, open_ = np.zeros_like(state), np.arange(len(state))
        while len(open_):
            key = state[open_] * len(self.words) + word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[open_[found]] = self.to[at[found]]
            open_ = open_[~found & (state[open_] > 0)]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return out


def build(terms: list[np.ndarray]) -> Automaton:
    """Automaton of terms, each an array of word hashes (not empty); equal terms are one."""
    words = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
    n = max(len(words), 1)
    length = np.array([len(t) for t in terms], np.int64)
    longest = int(length.max(initial=0))
    grid = np.full((len(terms), longest), -1, np.int64)
    if terms:
        grid[np.repeat(np.arange(len(terms)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.searchsorted(words, np.concatenate(terms))
    state = np.zeros(len(terms), np.int64)
    keys, to, parent, by = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    count, levels = 1, [np.zeros(1, np.int64)]
    for depth in range(longest):  # a level of the trie at a time
        own = np.flatnonzero(length > depth)
        key, which = np.unique(state[own] * n + grid[own, depth], return_inverse=True)
        new = count + np.arange(len(key))
        keys.append(key)
        to.append(new)
        parent.append(key // n)
        by.append(key % n)
        state[own] = new[which]
        levels.append(new)
        count += len(key)
    ends = np.full(count, -1, np.int64)
    ends[state[::-1]] = np.arange(len(terms))[::-1]
    ends[0] = -1
    keys, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to))
    order = np.argsort(keys)
    parent, by = np.concatenate(parent), np.concatenate(by)
    out = Automaton(words, np.append(keys[order], -1) if not len(keys) else keys[order], to[order] if len(to) else np.zeros(1, np.int64), np.zeros(count, np.int64), ends, np.zeros(count, np.int64))
    for level in levels[2:]:  # failure states by depth
        out.fail[level] = out.step(out.fail[parent[level]], by[level])
        f = out.fail[level]
        out.output[level] = np.where(ends[f] >= 0, f, out.output[f])
    return out


def find(a: Automaton, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of terms that occur in the rows' words."""
    none = np.zeros(0, np.int64)
    if not len(a.words) or not len(hashes):
        return none, none
    word = np.minimum(np.searchsorted(a.words, hashes), len(a.words) - 1)
    at = np.flatnonzero(a.words[word] == hashes)
    if not len(at):
        return none, none
    word, row = word[at], row[at]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]))
    length = np.diff(np.append(first, len(at)))
    order = np.argsort(-length, kind="stable")  # longest runs first, so that those still running are a prefix
    first, length = first[order], length[order]
    state = np.zeros(len(first), np.int64)
    rows, terms = [], []
    for k in range(int(length[0])):
        live = int(np.searchsorted(-length, -k, side="left"))
        state = a.step(state[:live], word[first[:live] + k])
        hit, of = np.where(a.ends[state] >= 0, state, a.output[state]), row[first[:live] + k]
        while True:
            some = hit > 0
            if not some.any():
                break
            hit, of = hit[some], of[some]
            rows.append(of)
            terms.append(a.ends[hit])
            hit = a.output[hit]
    if not rows:
        return none, none
    pair = np.unique(np.concatenate(rows) * len(a.ends) + np.concatenate(terms))
    return pair // len(a.ends), pair % len(a.ends)


def _search(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, companies, edges = shared.value
        for rows in slabs(batches, "_text", SLAB_BYTES):
            points, at = code_points(rows.column("_text"))
            start, end, row = word_bounds(points, at, letters_and_digits())
            row, term = find(automaton, word_hashes(points, start, end), row)
            # the companies of each term, once per row
            n = edges[term + 1] - edges[term]
            company = companies[np.repeat(edges[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair = np.unique(np.repeat(row, n) << 32 | company)
            edge = np.searchsorted(pair >> 32, np.arange(rows.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(edge), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), found], names=[*names, "_found"])

    return run


def _numbered(pairs: list[tuple]) -> tuple[tuple[Automaton, np.ndarray, np.ndarray], list]:
    """((automaton, company numbers by term, their edges), companies) of (company, lower-case term) pairs."""
    known = list(dict.fromkeys(c for c, _ in pairs))
    number = {c: i for i, c in enumerate(known)}
    points, edges = code_points(pa.array([t for _, t in pairs], pa.string()))
    start, end, row = word_bounds(points, edges, letters_and_digits())
    hashes = word_hashes(points, start, end)
    cut = np.searchsorted(row, np.arange(len(pairs) + 1))
    of: dict[bytes, set[int]] = {}
    for i, (company, _) in enumerate(pairs):
        if cut[i] < cut[i + 1]:  # a term without letters or digits matches nothing
            of.setdefault(hashes[cut[i]:cut[i + 1]].tobytes(), set()).add(number[company])
    numbers = [sorted(v) for v in of.values()]
    ends = np.concatenate([[0], np.cumsum([len(v) for v in numbers])]).astype(np.int64)
    return (build([np.frombuffer(k, np.uint64) for k in of]), np.array([x for v in numbers for x in v], np.int64), ends), known


def with_companies(df: DataFrame, text_col: str, companies: DataFrame, company_col: str = "company", term_col: str = "term", found_col: str = "company") -> DataFrame:
    """Every row of ``df`` once for each company of whose terms its text holds
    one, with the company in ``found_col`` (which replaces a column of that name).
    Null companies and terms match nothing. The terms are read at once: their size
    says how many automata there are, and each part of them is collected by itself."""
    spark = df.sparkSession
    pairs = companies.select(F.col(company_col).alias("company"), F.lower(F.col(term_col)).alias("term")).filter("company IS NOT NULL AND term IS NOT NULL")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]  # a term's arrays count, too
    parts = max(1, -(-size // AUTOMATON_BYTES))
    carried = [c for c in df.columns if c != found_col]
    names = [f"c{i}" for i in range(len(carried))]
    rows = df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(carried, names)), F.lower(F.col(text_col)).alias("_text"))
    kind = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(names, carried)), T.StructField("_found", T.ArrayType(T.IntegerType()))])
    names_kind = T.StructType([T.StructField("_found", T.IntegerType()), T.StructField("_company", pairs.schema["company"].dataType)])
    out = []
    for part in range(parts):
        own = pairs.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part) if parts > 1 else pairs
        arrays, known = _numbered([tuple(r) for r in own.collect()])
        hits = rows.mapInArrow(_search(spark.sparkContext.broadcast(arrays), names), kind).withColumn("_found", F.explode("_found"))
        hits = hits.join(F.broadcast(spark.createDataFrame(list(enumerate(known)), names_kind)), "_found")
        out.append(hits.select(*(F.col(n).alias(c) for n, c in zip(names, carried)), F.col("_company").alias(found_col)))
    return reduce(DataFrame.union, out)
