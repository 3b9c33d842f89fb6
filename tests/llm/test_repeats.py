from collections import Counter

from llm_rows import prose

from polarity.llm.repeats import remove_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force_on_edge_rows(edge_docs, edge_rows):
    want = brute([(r[0], r[1]) for r in edge_rows], 35)
    assert rows_of(remove_repeats(edge_docs)) == want
    assert sum(w[2] for w in want) > 500


def test_other_windows(edge_docs, edge_rows):
    short = [r for r in edge_rows if len(r[1] or "") < 10_000]
    docs = edge_docs.filter("text IS NULL OR length(text) < 10000")
    assert rows_of(remove_repeats(docs, window=4, mer=2)) == brute([(r[0], r[1]) for r in short], 4)


def test_hot_passage_across_many_rows(spark):
    passage = prose(1, 50)
    rows = [(i, f"{prose(i + 10, 6)} {passage} {prose(i + 9000, 5)}" if i % 3 else prose(i, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(remove_repeats(df)) == brute(rows, 35)


def test_carried_columns_and_empty_table(edge_docs, no_docs):
    done = remove_repeats(edge_docs, carry=["id", "key", "spans", "bucket", "text"])
    assert done.columns == ["id", "key", "spans", "bucket", "text", "n_words", "n_removed", "kept"]
    assert done.count() == edge_docs.count()
    assert remove_repeats(no_docs).collect() == []


def test_a_hot_minimiser_is_split(spark, monkeypatch):
    from polarity.llm import repeats as R
    common = prose(900, 20)
    rows = [(i, prose(2 * i, 40, 100_000) + " " + common + " " + prose(2 * i + 1 - (i % 50 == 0) * 2 * i, 40, 100_000)) for i in range(600)]
    rows += [(700 + i, rows[i][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    in_bucket = lambda: R._sent(df, "text", 35, 4, 64).selectExpr("bucket", "length(copies) AS n", "length(copies) AS c").filter("c > 0").groupBy("bucket").sum("n")
    monkeypatch.setattr(R, "HOT_STRINGS", 100)
    sizes = [r[1] for r in in_bucket().collect()]
    assert max(sizes) < 3 * sum(sizes) / 64
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in R.remove_repeats(df).collect()}
    assert got == {i: (n, gone, kept) for i, n, gone, kept in brute(rows, 35)}
    assert sum(gone > 0 for _, gone, _ in got.values()) >= 6


def test_rows_without_id_keep_what_is_their_own(spark):
    passage = prose(31, 60)
    rows = [(None, prose(40 + i, 50) + " " + (passage if i < 2 else "")) for i in range(40)] + [(None, prose(41, 50))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(remove_repeats(df)) == brute(rows, 35)


def test_texts_longer_than_a_stretch(edge_docs, edge_rows, monkeypatch):
    from polarity.llm import words as W
    import numpy as np
    x = W.mix(np.arange(5000, dtype=np.uint64) % np.uint64(700))
    for n in (1, 2, 7, 32):
        whole, cut = W.leftmost_min(x, n, 1 << 16), W.leftmost_min(x, n, 1 << 6)
        high = ~np.uint64((1 << 16) - 1)
        assert len(whole) == len(cut) == len(x) - n + 1
        assert all(x[i] & high == (x[k:k + n] & high).min() for k, i in enumerate(whole.tolist()))
        assert (cut - np.arange(len(cut)) < n).all() and (cut >= np.arange(len(cut))).all()
