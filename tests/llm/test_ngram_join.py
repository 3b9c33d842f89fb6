import pytest
from llm_rows import prose
from pyspark.sql import functions as F

from polarity.llm.components import connected_components
from polarity.llm.ngram_join import linked_groups


def shingles(text, n=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1))


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    low = lambda x: (x is not None, x or 0)  # noqa: E731  a null id is the smallest
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t) and top(a) != top(b):
                x, y = sorted((top(a), top(b)), key=low)
                up[y] = x
    return sorted(((i, len(s), top(i)) for i, s in sets), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force_on_edge_rows(edge_docs, edge_rows):
    assert rows_of(linked_groups(edge_docs)) == brute([(r[0], r[1]) for r in edge_rows])


def test_chains_near_copies_and_common_passages(spark):
    base = [f"b{k}" for k in range(120)]
    common = prose(77, 40)
    rows = [(1000 - k, " ".join(base[k:] + [f"t{j}" for j in range(k)])) for k in range(0, 40, 2)]     # a chain of near copies
    rows += [(2000 + k, " ".join([*base[:60], f"u{k}", *base[60:]])) for k in range(60)]                # one large group
    rows += [(3000 + k, f"{common} {prose(k, 4)}") for k in range(40)]                                  # share most, but not enough
    rows += [(4000 + k, f"{common} {prose(k, 60)}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(linked_groups(df))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < 90


def test_empty_table(no_docs):
    assert linked_groups(no_docs).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    want = {}
    for a, b in edges:
        if a != b:
            want |= {x: min([x, a, b]) for x in (a, b)}
    for _ in edges:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert {r[0]: r[1] for r in connected_components(df.select(F.col("a"), F.col("b"))).collect()} == want
