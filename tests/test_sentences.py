from pyspark.sql import functions as F

from polarity.operators import sentences as S


def test_raw_words(spark):
    rows = [('He said "It\'s 3.5% (up)", didn\'t he?', ["He", "said", "``", "It", "'s", "3.5", "%", "(", "up", ")", "''", ",", "did", "n't", "he", "?"]),
            ("We'll pay $1,000.50... well-known U.S. firms!", ["We", "'ll", "pay", "$", "1,000.50", "...", "well-known", "U", ".", "S", ".", "firms", "!"]),
            ("", []), (None, []), (" \n ", []), ("é-ü CAN'T", ["é-ü", "CA", "N'T"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
    got = {r.i: r.w for r in df.select("i", S.raw_words("text").alias("w")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_abbreviations_are_learned_from_the_texts(spark):
    texts = ["Dr. Who met Corp. staff. They left."] * 6 + ["The end. It is the end of all. See J. Smith! \"Yes.\" No? ok."] * 3 + [None, "", "one"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, `a.b` string")
    assert {r.token for r in S.abbreviations(df, "text").collect()} == {"dr", "corp", "staff", "left"}
    assert {r.token for r in S.abbreviations(df, "text", longest=4).collect()} == {"dr", "corp", "left"}
    known = spark.createDataFrame([("dr",), ("corp",)], "token string")
    out = S.with_sentences(df, "text", known=known)
    assert out.columns == ["id", "text", "a.b", "sentences"]
    got = {r.id: r.sentences for r in out.collect()}
    assert got[0] == ["Dr. Who met Corp. staff.", "They left."]
    assert got[6] == ["The end.", "It is the end of all.", "See J. Smith!", '"Yes."', "No? ok."]
    assert got[9] == [] and got[10] == [] and got[11] == ["one"]
    whole = S.with_sentences(df, "text")
    assert whole.filter(F.array_join("sentences", " ") != F.coalesce("text", F.lit(""))).count() == 0


def test_base_of_a_word():
    assert [S._base(w) for w in ("Dr", "(U.S", "x--corp", "", "a.b.c", "...")] == ["dr", "u.s", "corp", "", "a.b.c", ""]
