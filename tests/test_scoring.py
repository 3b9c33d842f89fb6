"""Scorers (M1-M5, M9): contract, invariants and plan shape."""

import math

import pytest
from pyspark.sql import functions as F

from polarity.functions.text import basic_clean, tokenize
from polarity.operators import large_lexicon
from polarity.operators import scoring as S

LEX = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("terrible", -3.1), ("flat", 0.0)]
NEG = ["not", "never"]
DEG = [("very", 0.3), ("slightly", -0.3)]

# own sentences: five groups of three
TEXTS = [
    (1, "positive", "A great quarter, good margins and a good outlook."),
    (2, "positive", "Very good results: great demand."),
    (3, "positive", "Good news again, the team did great."),
    (4, "negative", "A bad quarter with terrible guidance."),
    (5, "negative", "Not good at all, very bad."),
    (6, "negative", "Terrible sales and bad costs."),
    (7, "neutral", "The meeting starts at nine."),
    (8, "neutral", "Shares were flat on Monday."),
    (9, "neutral", "The report lists the board members."),
    (10, "mixed", "Good revenue but bad cash flow."),
    (11, "mixed", "Great product, terrible support."),
    (12, "mixed", "Not bad, not great either."),
    (13, "technical", "EBITDA margin moved 30 basis points."),
    (14, "technical", "The ratio was 1.2 for the period."),
    (15, "technical", "Capex slightly above plan, never terrible."),
    (16, "empty", ""),
    (17, "empty", "!!! ???"),
    (18, "null", None),
]


def brute(tokens, lex=dict(LEX), neg=set(NEG), deg=dict(DEG), factor=0.75, alpha=15.0):
    vals = []
    for i, t in enumerate(tokens):
        v = lex.get(t, 0.0)
        prev = tokens[max(0, i - 3):i]
        if v != 0:
            v += math.copysign(1, v) * sum(deg.get(p, 0.0) for p in prev)
            if any(p in neg for p in prev):
                v *= -factor
        vals.append(v)
    s = sum(vals)
    p = sum(v + 1 for v in vals if v > 0)
    n = sum(1 - v for v in vals if v < 0)
    z = sum(1 for v in vals if v == 0)
    tot = p + n + z
    comp = s / math.sqrt(s * s + alpha)
    lab = "positive" if comp >= 0.05 else "negative" if comp <= -0.05 else "neutral"
    if tot == 0:
        return 0.0, 0.0, 0.0, comp, lab
    return p / tot, n / tot, z / tot, comp, lab


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, expected string, text string")


def scorer():
    return S.LexiconScorer(LEX, NEG, DEG)


def test_lexicon_matches_brute_force(spark, docs):
    toks = {r.id: r.t for r in docs.select("id", tokenize(basic_clean("text")).alias("t")).collect()}
    sc = scorer().score(docs, "text", None, "", with_compound=True)
    rows = {r.id: r for r in sc.collect()}
    assert len(rows) == len(TEXTS)
    for i, t in toks.items():
        pos, neg, neu, comp, lab = brute(t)
        r = rows[i]
        assert (r.positive, r.negative, r.neutral, r.compound) == pytest.approx((pos, neg, neu, comp)), i
        assert r.label == lab, i


def test_shares_sum_to_one_and_labels(spark, docs):
    sc = scorer().score(docs, "text", "id")
    for r in sc.collect():
        total = r.sentiment_positive + r.sentiment_negative + r.sentiment_neutral
        if r.expected in ("empty", "null"):
            assert total == 0 and r.sentiment_label == "neutral"
        else:
            assert round(total, 1) == 1.0
        assert r.sentiment_label in ("positive", "negative", "neutral")


def test_clear_texts_classified(spark, docs):
    sc = scorer().score(docs, "text", "id").filter(F.col("expected").isin("positive", "negative"))
    assert sc.filter(F.col("expected") != F.col("sentiment_label")).count() == 0
    # confidence on clear texts
    conf = sc.select(F.greatest("sentiment_positive", "sentiment_negative", "sentiment_neutral").alias("c"))
    assert conf.agg(F.min("c")).first()[0] > 0.3


def test_negation_and_degree(spark):
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, "not very good")],
                               "id long, text string")
    sc = {r.id: r for r in scorer().score(df, "text", None, "", with_compound=True).collect()}
    assert sc[2].compound < 0 < sc[1].compound < sc[3].compound
    assert sc[4].compound == pytest.approx(brute(["not", "very", "good"])[3])


def test_score_keeps_columns_and_rows(spark, docs):
    out = S.score(docs, "text", scorer(), "id")
    assert out.columns[:3] == docs.columns
    assert set(out.columns) - set(docs.columns) == {"sentiment_positive", "sentiment_negative",
                                                     "sentiment_neutral", "sentiment_label"}
    assert out.count() == docs.count()
    with pytest.raises(ValueError):
        S.score(docs, "missing", scorer(), "id")
    assert S.score(docs, "text").count() == docs.count()  # the default scorer needs no id


def test_repeatable(spark, docs):
    a = scorer().score(docs, "text", "id")
    b = scorer().score(docs, "text", "id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scores_in_the_row(spark, docs):
    plan = scorer().score(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


REPEATED = [(1, "good news"), (1, "bad bad news"), (None, "good"), (None, "nothing"), (2, "very good"), (2, "very good")]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame(REPEATED, "id long, text string")
    out = scorer().score(df, "text", "id").collect()
    assert len(out) == len(REPEATED)
    for r in out:
        shares = (r.sentiment_positive, r.sentiment_negative, r.sentiment_neutral)
        assert all(0 <= x <= 1 for x in shares) and sum(shares) == pytest.approx(1)
    assert {(r.text, r.sentiment_label) for r in out} >= {("good news", "positive"), ("bad bad news", "negative")}


def test_repeated_lexicon_tokens(spark):
    df = spark.createDataFrame([(1, "good day")], "id long, text string")
    r = S.LexiconScorer([("good", 2.0)] * 3).score(df, "text").first()
    once = S.LexiconScorer([("good", 2.0)]).score(df, "text").first()
    assert r == once and 0 < r.sentiment_neutral < 1
    with pytest.raises(ValueError, match="more than one valence"):
        S.LexiconScorer([("good", 2.0), ("good", 1.0)])


def test_large_lexicon_tables_are_hashed_in_the_row(spark, docs, monkeypatch):
    table = S.lexicon_frame(spark, [*LEX, LEX[0]])
    repeated = spark.createDataFrame(REPEATED, "id long, text string")
    small = [S.LexiconScorer(table, NEG, DEG).score(d, "text", with_compound=True) for d in (docs, repeated)]
    monkeypatch.setattr(S, "IN_PLAN_ENTRIES", 2)
    for parts in (8_000_000, 3):
        monkeypatch.setattr(large_lexicon, "PART_ENTRIES", parts)
        for d, want in zip((docs, repeated), small):
            got = S.LexiconScorer(table, NEG, DEG).score(d, "text", with_compound=True)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
            cols = [*d.columns, "sentiment_label", *[F.round(f"sentiment_{c}", 9).alias(c) for c in (*S.SCORE_CLASSES, "compound")]]
            assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == want.count()
    clash = S.LexiconScorer(S.lexicon_frame(spark, [*LEX, (LEX[0][0], 9.0)]), NEG, DEG)
    with pytest.raises(Exception, match="more than one valence"):
        clash.score(docs, "text", "id").collect()


def test_registry(spark):
    assert "lexicon" in S.available_scorers() and "keyword" in S.available_scorers()
    assert isinstance(S.create_scorer("LEXICON"), S.LexiconScorer)
    assert isinstance(S.create_scorer(None), S.LexiconScorer)
    with pytest.raises(ValueError, match="registered"):
        S.create_scorer("no-such-model")


def test_model_scorer_rows_and_softmax(spark, docs):
    m = S.create_scorer("keyword", keywords=(("good", "great"), ("bad", "terrible"), ("flat",)))
    out = m.score(docs.withColumn("clean", basic_clean("text")), "clean", prefix="kw_")
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.kw_positive + r.kw_negative + r.kw_neutral == pytest.approx(1.0)
    one = {r.id: r for r in rows}
    assert one[1].kw_label == "positive" and one[4].kw_label == "negative"
    assert one[7].kw_label == "positive"  # all logits 0: the first class wins
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_label_order_is_a_model_property(spark):
    df = spark.createDataFrame([(1, "bad bad")], "id long, text string")
    m = S.ModelScorer(lambda: S.KeywordModel([("bad",), ("good",), ()]), ["negative", "positive", "neutral"])
    r = m.score(df, "text").first()
    assert r.sentiment_label == "negative" and r.sentiment_negative > r.sentiment_positive


def test_compare_models_long_form(spark, docs):
    models = {"lex": scorer(), "kw": S.create_scorer("keyword")}
    out = S.compare_models(docs, "text", "id", models)
    assert out.count() == len(TEXTS) * 2
    assert set(out.columns) == {"id", "model", "positive", "negative", "neutral", "label"}


def test_several_token_lists_in_one_pass(spark, docs):
    toks = docs.select("id", tokenize(basic_clean("text")).alias("t"))
    multi = S.add_lexicon_scores(toks, {"a_": F.col("t"), "b_": F.slice("t", 1, 3)}, LEX, NEG, DEG).drop("t")
    a = S.lexicon_scores(toks, "id", "t", LEX, NEG, DEG, prefix="a_")
    b = S.lexicon_scores(toks.withColumn("t", F.slice("t", 1, 3)), "id", "t", LEX, NEG, DEG, prefix="b_")
    joined = a.join(b, "id")
    assert multi.select(*sorted(joined.columns)).exceptAll(joined.select(*sorted(joined.columns))).count() == 0


def test_score_if_needed(spark, docs):
    out, cols, lab = S.score_if_needed(docs, "text", model=scorer(), id_col="id")
    assert lab == "sentiment_label" and cols[0] == "sentiment_positive"
    same, cols2, lab2 = S.score_if_needed(out, "text", cols, lab)
    assert same is out
    with pytest.raises(ValueError):
        S.score_if_needed(docs, "text", ["nope"], "sentiment_label")


def test_compare_models_mixed_equals_single(spark, docs):
    other = S.LexiconScorer([("bad", -1.0), ("good", 0.5)], [], [])
    kw = S.create_scorer("keyword", keywords=(("good",), ("bad",), ()))
    models = {"lex": scorer(), "lex2": other, "kw": kw}
    out = S.compare_models(docs, "text", "id", models)
    assert out.count() == len(TEXTS) * 3
    cols = ["id", "positive", "negative", "neutral", "label"]
    for name, m in models.items():
        alone = m.score(docs, "text", "id", "").select(*cols)
        got = out.filter(F.col("model") == name).select(*cols)
        assert got.exceptAll(alone).count() == 0 and alone.exceptAll(got).count() == 0, name


def test_single_text_helpers(spark):
    rec = S.analyze_text(spark, "A great and very good day.", S.LexiconScorer(LEX, NEG, DEG))
    assert rec["label"] == "positive" and round(rec["positive"] + rec["negative"] + rec["neutral"], 1) == 1.0
    both = S.compare_models_on_text(spark, "bad bad news", {"lex": S.LexiconScorer(LEX, NEG, DEG),
                                                            "kw": S.create_scorer("keyword")})
    assert set(both) == {"lex", "kw"} and both["lex"]["label"] == "negative"


def test_batches_by_length_score_every_text_once_with_little_padding(spark, monkeypatch):
    assert S.length_batches([], 10) == [] and S.length_batches([0, 0], 10) == [[0, 1]]
    assert S.length_batches([50, 1, 2, 9, 1], 10) == [[0], [3], [2, 1, 4]]
    assert S.length_batches([1] * 5, 100, 2) == [[0, 1], [2, 3], [4]]
    rows = [(i, " ".join(["good"] * (400 if i % 40 == 0 else i % 7) + ["bad"] * (i % 3))) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    model = lambda: S.KeywordModel([("good",), ("bad",), ()])
    plain = S.model_scores(df, "text", model, prefix="p_")
    cols = ["id", *[f"p_{c}" for c in S.SCORE_CLASSES], "p_label"]
    for buffer in (4096, 50):
        monkeypatch.setattr(S, "BUFFER_ROWS", buffer)
        out = S.ModelScorer(model, batch_size=None, token_budget=600).score(df, "text", prefix="p_")
        assert out.select(cols).exceptAll(plain.select(cols)).count() == 0 and out.count() == 901
        padded = out.agg(F.avg("p_padded")).first()[0]
        slots = lambda n: sum(max(len((rows[j][1] or "").split()) for j in range(i, min(i + n, 900))) * n for i in range(0, 900, n))
        unsorted = 1 - sum(len((t or "").split()) for _, t in rows) / slots(16)
        assert padded < unsorted / 2
