import random

import numpy as np
from llm_rows import prose
from test_ngram_join import brute

from polarity.llm import minhash_tables as M


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def want(rows, percent=85):
    return sorted(((i, n, c, i == c) for i, n, c in brute(rows, percent)), key=str)


def near(words, seed, edits):
    r, words = random.Random(seed), list(words)
    for k in range(edits):
        words[r.randrange(len(words))] = f"e{seed}x{k}"
    return " ".join(words)


def test_edge_rows(edge_docs, edge_rows, no_docs):
    assert rows_of(M.near_duplicates(edge_docs)) == want([(r[0], r[1]) for r in edge_rows])
    assert M.near_duplicates(no_docs).collect() == []


def test_near_copies_at_all_similarities(spark):
    rows = []
    for g in range(25):
        base = prose(g, 60 + 7 * g).split()
        rows += [(100 * g + k, near(base, 100 * g + k, k % 6)) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(M.near_duplicates(df))
    assert got == want(rows)
    assert 25 < len({r[2] for r in got}) < 180


def test_a_large_group_of_near_copies(spark):
    base = prose(1, 150).split()
    rows = [(k, near(base, k, 1 + k % 5)) for k in range(300)] + [(1000 + k, prose(500 + k, 80)) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(M.near_duplicates(df)) == want(rows)


def test_rows_of_one_id(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (5, b), (9, near(c.split(), 1, 1)), (7, c), (None, c), (None, a), (3, None)]
    got = rows_of(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(i, g) for i, _, g, _ in got} == {(1, None), (5, None), (9, None), (7, None), (None, None), (3, 3)}
    assert [r[3] for r in got] == [r[0] == r[2] for r in got]


def test_sub_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    common, hits = r.integers(0, 2**63, 170, dtype=np.uint64), 0
    for _ in range(300):
        x = [np.concatenate([common[:170], r.integers(0, 2**63, 15, dtype=np.uint64)]) for _ in "ab"]  # similarity 0.85
        common = r.integers(0, 2**63, 170, dtype=np.uint64)
        a, b = M.signatures(np.concatenate(x), np.array([185, 185]), 16, 3)
        hits += (a == b).sum()
        assert (a == b).sum() >= 2
    assert abs(hits / (300 * 16) - 0.85**3) < 0.04
