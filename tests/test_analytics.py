"""Aggregations (A1-A14), filters and rankings (P4, P5, L2) against
numpy/pandas computations on small own fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polarity.operators import analytics as A
from polarity.operators import ranking as R
from polarity.operators import reshape as U


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    rows = []
    labels = ["positive", "negative", "neutral", None]
    for i in range(240):
        p, n = rng.random(), rng.random()
        z = max(0.0, 1 - p - n)
        la, lb = labels[i % 4], labels[(i // 3) % 4]
        rows.append((i, f"c{i % 5}", "news" if i % 2 else "posts", p, n, z, la, p * 0.5 + rng.random() * 0.2,
                     n * 0.8, z, lb))
    cols = ("id long, company string, source_type string, sentiment_positive double, sentiment_negative double, "
            "sentiment_neutral double, sentiment_label string, b_positive double, b_negative double, "
            "b_neutral double, b_label string")
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])


def test_mean_scores(scored):
    df, pdf = scored
    got = {r.company: r for r in A.mean_scores(df, ["company"]).collect()}
    want = pdf.groupby("company")[["sentiment_positive", "sentiment_negative"]].mean()
    for c, r in got.items():
        assert r.positive == pytest.approx(want.loc[c, "sentiment_positive"])
        assert r.negative == pytest.approx(want.loc[c, "sentiment_negative"])
    assert A.overall_mean(df.limit(0), "sentiment_positive").first()[0] is None


def test_label_distribution(scored):
    df, pdf = scored
    rows = A.label_distribution(df, "sentiment_label").collect()
    vc = pdf["sentiment_label"].value_counts()
    assert [r.label for r in rows] == list(vc.index) or sorted(r.n for r in rows) == sorted(vc.values)
    assert sum(r.pct for r in rows) == pytest.approx(100.0)
    with_null = A.label_distribution(df, "sentiment_label", include_null=True).collect()
    assert len(with_null) == 4 and sum(r.n for r in with_null) == len(pdf)


def test_agreement_null_never_agrees(scored):
    df, pdf = scored
    got = A.agreement(df, "sentiment_label", "b_label").first().agreement_pct
    same = (pdf.sentiment_label == pdf.b_label) & pdf.sentiment_label.notna()
    assert got == pytest.approx(100 * same.mean())


def test_disagreements_and_severity(scored):
    df, pdf = scored
    dis = R.disagreements(df, "sentiment_label", "b_label")
    want = pdf[~((pdf.sentiment_label == pdf.b_label) & pdf.sentiment_label.notna())]
    assert dis.count() == len(want)
    top = R.top_disagreements(df.withColumnRenamed("sentiment_label", "a_label")
                              .withColumnRenamed("sentiment_positive", "a_positive")
                              .withColumnRenamed("sentiment_negative", "a_negative")
                              .withColumnRenamed("sentiment_neutral", "a_neutral"),
                              "a_label", "b_label", "id", 5).collect()
    sev = (abs(want.sentiment_positive - want.b_positive) + abs(want.sentiment_negative - want.b_negative)
           + abs(want.sentiment_neutral - want.b_neutral))
    assert [r.id for r in top] == list(want.assign(s=sev).sort_values(["s", "id"], ascending=[False, True]).id[:5])


def test_accuracy_and_metrics(spark):
    y = ["pos", "pos", "neg", "neg", "neu", "pos", "neg", "neu"]
    p = ["pos", "neg", "neg", "neg", "pos", "pos", None, "neu"]
    df = spark.createDataFrame(list(zip(range(8), y, p)), "id int, y string, p string")
    acc = {r.expected: r for r in A.accuracy(df, "p", "y").collect()}
    assert acc["__all__"].correct == 5 and acc["pos"].accuracy == pytest.approx(2 / 3)
    m = A.classification_metrics(df.fillna({"p": "none"}), "y", "p").first()
    # support-weighted precision / recall / F1, as in the usual definition
    classes = sorted(set(y) | set(x or "none" for x in p))
    pp = [x or "none" for x in p]
    sup = {c: y.count(c) for c in classes}
    prec = {c: (sum(1 for a, b in zip(y, pp) if a == b == c) / pp.count(c)) if pp.count(c) else 0 for c in classes}
    rec = {c: (sum(1 for a, b in zip(y, pp) if a == b == c) / sup[c]) if sup[c] else 0 for c in classes}
    f1 = {c: 2 * prec[c] * rec[c] / (prec[c] + rec[c]) if prec[c] + rec[c] else 0 for c in classes}
    n = len(y)
    assert m.accuracy == pytest.approx(5 / 8)
    assert m.precision == pytest.approx(sum(prec[c] * sup[c] for c in classes) / n)
    assert m.recall == pytest.approx(sum(rec[c] * sup[c] for c in classes) / n)
    assert m.f1 == pytest.approx(sum(f1[c] * sup[c] for c in classes) / n)


def test_metrics_equal_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "label double, prediction double")
    m = A.classification_metrics(df, "label", "prediction").first()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    assert m.f1 == pytest.approx(ev.evaluate(df, {ev.metricName: "f1"}))
    assert m.precision == pytest.approx(ev.evaluate(df, {ev.metricName: "weightedPrecision"}))
    assert m.recall == pytest.approx(ev.evaluate(df, {ev.metricName: "weightedRecall"}))
    assert m.accuracy == pytest.approx(ev.evaluate(df, {ev.metricName: "accuracy"}))


def test_correlation(scored):
    df, pdf = scored
    got = A.correlation(df, "sentiment_positive", "b_positive").first().pearson
    assert got == pytest.approx(np.corrcoef(pdf.sentiment_positive, pdf.b_positive)[0, 1])


def test_mean_matrix_long_and_wide(scored):
    df, pdf = scored
    long = A.mean_matrix(df, "source_type", "company", "sentiment_positive")
    wide = A.mean_matrix(df, "source_type", "company", "sentiment_positive", ["news", "posts"], wide=True)
    pt = pdf.pivot_table(index="company", columns="source_type", values="sentiment_positive", aggfunc="mean")
    for r in wide.collect():
        assert r.news == pytest.approx(pt.loc[r.company, "news"])
    assert long.count() == pt.size


def test_entity_matrix(spark):
    means = spark.createDataFrame([("a", 0.1, 0.2, 0.7), ("b", 0.5, 0.3, 0.2)],
                                  "company string, positive double, negative double, neutral double")
    assert A.entity_matrix(means, "company").count() == 6


def test_box_stats_exact_and_whiskers(scored):
    df, pdf = scored
    long = U.melt_scores(df, ["id", "sentiment_label"],
                         ["sentiment_positive", "sentiment_negative", "sentiment_neutral"], with_model=False)
    got = {(r.score_type, r.sentiment_label): r for r in A.box_stats(long, ["score_type", "sentiment_label"]).collect()}
    for (st, lab), r in got.items():
        v = pdf[pdf.sentiment_label.isna() if lab is None else pdf.sentiment_label == lab][f"sentiment_{st}"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        assert r.whisker_low == pytest.approx(inside.min()) and r.whisker_high == pytest.approx(inside.max())
        assert r.n_outliers == int(((v < lo) | (v > hi)).sum()) and r.n == len(v)
    approx = A.box_stats(long, ["score_type", "sentiment_label"], exact=False)
    assert approx.count() == len(got)


def test_distinct_counts_confidence(scored):
    df, pdf = scored
    assert A.distinct_labels(df, "sentiment_label").count() == 4
    assert {r.company: r.n_rows for r in A.row_counts(df, ["company"]).collect()} == \
        pdf.company.value_counts().to_dict()
    conf = A.mean_confidence(df, ["sentiment_positive", "sentiment_negative", "sentiment_neutral"]).first()
    want = pdf[["sentiment_positive", "sentiment_negative", "sentiment_neutral"]].max(axis=1)
    assert conf.mean_confidence == pytest.approx(want.mean())


def test_melt_strips_prefixes_and_keeps_model(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4)],
                               "id int, sentiment_positive double, vader_positive double, "
                               "finbert_positive double, finbert_finetuned_positive double")
    rows = {r.model: r.score_type for r in U.melt_scores(df, ["id"], df.columns[1:]).collect()}
    assert rows == {"sentiment": "positive", "vader": "positive", "finbert": "positive",
                    "finbert_finetuned": "finetuned_positive"}


def test_filters(scored):
    df, pdf = scored
    assert R.filter_equals(df, "source_type", "news").count() == (pdf.source_type == "news").sum()
    assert R.clear_cases(df, "sentiment_label").count() == pdf.sentiment_label.isin(["positive", "negative"]).sum()


def test_box_stats_of_a_hot_group(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    # one hot group with many distinct values, small groups, ties, a null group
    rows = [("hot", float(x)) for x in rng.normal(0, 1, 3000)]
    rows += [("tie", 1.0)] * 50 + [("tie", 2.0)] * 3 + [("one", 7.0)]
    rows += [(None, float(x)) for x in rng.integers(0, 5, 40)]
    df = spark.createDataFrame(rows, "g string, score double")
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    for got in (A.box_stats(df, ["g"]), A.box_stats(df, ["g"], blocks=7)):
        got = {r.g: r for r in got.collect()}
        assert set(got) == set(by)
        for g, xs in by.items():
            q1, q2, q3 = np.percentile(xs, [25, 50, 75])
            inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
            r = got[g]
            assert (r.n, r.n_outliers) == (len(xs), len(xs) - len(inside))
            assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == pytest.approx((q1, q2, q3, min(inside), max(inside)))
