"""The pipeline, stage by stage against brute force, and as a whole."""

import pytest
from test_decontaminate import brute as brute_items
from test_ngram_join import brute as brute_links
from test_repeats import brute as brute_repeats

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and the result of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [k for k, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[1:-1])


def test_toxic_documents_go_and_others_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert sum(i in kept for i, t in labels.items() if t) <= 0.35 * sum(labels.values())
    assert sum(i not in kept for i, t in labels.items() if not t) <= 0.05 * len(labels)
    assert set(rows_of(stages[1])) <= set(rows_of(stages[0]))


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = stages[1].collect()
    want = {i for i, _, c in brute_links([(r["doc_id"], r["text"]) for r in rows]) if i == c}
    assert rows_of(stages[2]) == sorted((tuple(r) for r in rows if r["doc_id"] in want), key=str)
    assert len(want) < len(rows)


def test_repeated_passages_are_cut(stages):
    rows = stages[2].collect()
    cut = {i: (n, gone, kept) for i, n, gone, kept in brute_repeats([(r["doc_id"], r["text"]) for r in rows], 35)}
    want = []
    for r in rows:
        n, gone, kept = cut[r["doc_id"]]
        if gone == 0:
            want.append(tuple(r))
        elif gone < n:
            want.append(tuple({**r.asDict(), "text": kept, "n_chars": len(kept)}.values()))
    assert rows_of(stages[3]) == sorted(want, key=str)


def test_contaminated_documents_go(spark, stages):
    rows = stages[3].collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute_items([(r["doc_id"], r["text"]) for r in rows], items) if not hit}
    assert rows_of(stages[4]) == sorted((tuple(r) for r in rows if r["doc_id"] in clean), key=str)
    assert len(clean) < len(rows)


def test_bins_hold_whole_documents_without_conflicts(stages):
    docs = {r["doc_id"]: r for r in stages[4].collect()}
    rows = [r.asDict() for r in stages[5].collect()]
    words = {i: len((r["text"] or "").encode().split()) for i, r in docs.items()}
    for i, n in words.items():
        mine = sorted((r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(k for _, k in mine) == n and [s for s, _ in mine] == [2048 * k for k in range(len(mine))]
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= 2048
        sources = [docs[r["doc_id"]]["source"] for r in b]
        assert len(sources) == len(set(sources))


def test_run_is_the_chain_of_stages(spark, stages):
    assert rows_of(C.run(spark, SF)) == rows_of(stages[5])


def test_stages_take_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    for _, stage in C.STAGES[:-1]:
        done = stage(spark, edge_docs, SF)
        assert done.columns == edge_docs.columns and done.count() > 0
        assert stage(spark, no_docs, SF).collect() == []
    assert C.pack_bins(spark, edge_docs, SF).count() >= edge_docs.count()
    kept = C.drop_near_copies(spark, edge_docs, SF).collect()
    assert [r["doc_id"] for r in kept].count(10) == 0 and [r["doc_id"] for r in kept].count(8) == 1


def test_rows_of_one_id_are_documents_of_their_own(spark):
    from llm_rows import prose
    x, y = "Aa " + prose(71, 200), "Zz " + prose(72, 200)
    words = y.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    other = "Mm " + prose(73, 200)
    rows = [(5, x), (5, y), (7, near), (None, other), (None, other), (None, x), (None, prose(74, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(C.drop_near_copies(spark, docs, SF))
    assert got == sorted([(5, x), (5, y), (None, other), (None, rows[-1][1])], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, x + " " + item), (1, x), (None, y + " " + item), (None, y)], "doc_id long, text string")
    assert rows_of(C.drop_contaminated(spark, docs, SF)) == sorted([(1, x), (None, y)], key=str)
