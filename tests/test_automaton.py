"""Many-term search: the automaton against a plain search, and its cost."""

import random
import time

import numpy as np
import pyarrow as pa

from polarity.functions import word_runs as R
from polarity.sources import automaton as A
from polarity.sources.filters import companies_frame, mentions


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def holds(text, term):
    t, w = words_of(text), words_of(term)
    return bool(w) and any(t[i:i + len(w)] == w for i in range(len(t)))


def test_random_terms_and_texts_with_nested_and_overlapping_terms(spark, monkeypatch):
    r = random.Random(4)
    line = lambda n, k: " ".join(r.choice(["a", "b", "ab", "É", "3m", "ß", "日本", "x1"][:k]) for _ in range(n))
    terms = [(f"C{i % 60}", line(r.randrange(1, 6), 3 + i % 6)) for i in range(150)] + [("N", "..."), ("N", None), (None, "a"), ("S", "$A.b!")]
    texts = [(i, r.choice([" ", ", ", "--"]).join(line(r.randrange(8), 8).split())) for i in range(300)] + [(900, None), (901, ""), (902, "a b " * 400)]
    want = sorted({(i, c) for i, t in texts for c, term in terms if c and term and holds(t, term)})
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    companies = spark.createDataFrame(terms, "company string, term string")
    assert sorted(tuple(x) for x in mentions(df, "text", "id", companies).collect()) == want
    assert len(want) > 1500
    monkeypatch.setattr(A, "AUTOMATON_BYTES", 2000)  # several automata
    assert sorted(tuple(x) for x in mentions(df, "text", "id", companies).collect()) == want


def test_columns_of_any_name_and_no_terms(spark):
    df = spark.createDataFrame([(1, "buy acme", 2, "c")], "c0 int, text string, _found int, `a.b` string")
    got = A.with_companies(df, "text", companies_frame(spark, [("X", "Acme")]))
    assert got.columns == ["c0", "text", "_found", "a.b", "company"] and [tuple(r) for r in got.collect()] == [(1, "buy acme", 2, "c", "X")]
    assert A.with_companies(df, "text", companies_frame(spark, [("X", "acme")]).limit(0)).collect() == []


def test_time_grows_with_the_words_of_a_text():
    terms = [R.hashes_of(["same"] * n) for n in range(1, 40)] + [R.hashes_of([f"t{i}", "same"]) for i in range(10_000)]
    a = A.build(terms)

    def seconds(n):
        points, edges = R.code_points(pa.array(["same " * n]))
        t = time.process_time()
        start, end, row = R.word_bounds(points, edges, R.letters_and_digits())
        found = A.find(a, R.word_hashes(points, start, end), row)
        assert len(found[0]) == min(n, 39)
        return time.process_time() - t

    seconds(100)
    assert seconds(20_000) < 6 * max(seconds(5_000), 0.05)


def test_hashes_tell_words_apart():
    words = sorted({f"{a}{b}" for a in "abcdeé" for b in range(500)} | {"a", "aa", "aaa", "ab", "ba"})
    assert len(np.unique(R.hashes_of(words))) == len(words)
    points, edges = R.code_points(pa.array(["x ab é0", None, "ab"]))
    start, end, row = R.word_bounds(points, edges, R.letters_and_digits())
    assert row.tolist() == [0, 0, 0, 2]
    assert R.word_hashes(points, start, end).tolist() == R.hashes_of(["x", "ab", "é0", "ab"]).tolist()
