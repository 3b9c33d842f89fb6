import pytest
from pyspark.sql import functions as F

from polarity.operators import lemma as L
from polarity.operators import rule_lemmas as R
from polarity.operators.preprocess import preprocess_dataframe


def test_rules_are_met_from_the_end():
    trie = R.suffix_trie(R.RULES)
    assert [b for _, b in sorted(R.bases("churches", trie))] == ["church", "churche"]
    assert [b for _, b in sorted(R.bases("trading", trie))] == ["trad", "trade"]
    assert R.bases("glass", trie) == [] and R.bases("s", trie) == [] and R.bases("", trie) == []


def test_only_words_of_the_corpus_are_bases(spark):
    texts = ["trading trade trades firms firm glasses glass", "churches church ponies pony men man bus buses", "xyzs qing", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.text for r in preprocess_dataframe(df, "text", remove_stops=False, lemmatize_text=True).collect()}
    assert got == {0: "trade trade trade firm firm glass glass", 1: "church church pony pony man man bus bus", 2: "xyzs qing", 3: "", 4: ""}


@pytest.mark.parametrize("entries", [4_000_000, 7])
def test_tables_of_any_size_give_the_same_result(spark, monkeypatch, entries):
    pairs = [(f"t{i}", f"t{i + 1}") for i in range(40)] + [("t5", "a"), ("same", "same"), (None, "x"), ("y", None)]
    table = L.lemma_frame(spark, pairs)
    df = spark.createDataFrame([(1, [f"t{i}" for i in range(0, 60, 3)] + ["same", "é", ""]), (2, []), (3, None), (4, ["t5", "t5"])], "id int, toks array<string>")
    want = [tuple(r) for r in L.lemmatize_tokens(df, "toks", table).orderBy("id").collect()]
    monkeypatch.setattr(L, "DICTIONARY_ROWS", 3)
    monkeypatch.setattr(R, "PART_ENTRIES", entries)
    assert [tuple(r) for r in L.lemmatize_tokens(df, "toks", table).orderBy("id").collect()] == want
    texts = df.select("id", F.array_join("toks", " ").alias("text"))
    assert L.lemmatize(texts, "text", table).filter("id = 4").first().text == "a a"
