"""Training (M6), persistence (M7) and scoring with the trained model."""

import os

import pytest
from pyspark.sql import functions as F

from polarity.operators import training as TR
from polarity.operators.scoring import create_scorer

POS = ["strong demand lifts results", "record sales and higher margins", "upbeat guidance pleases holders",
       "profits climb on good orders", "growth beats every forecast"]
NEG = ["weak demand hurts results", "falling sales and lower margins", "gloomy guidance worries holders",
       "losses widen on poor orders", "decline misses every forecast"]


@pytest.fixture(scope="module")
def train_df(spark):
    rows = []
    for i in range(200):
        rows.append((i, POS[i % 5] + f" item{i % 7}", 2))
        rows.append((1000 + i, NEG[i % 5] + f" item{i % 7}", 0))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_train_predict_save_load(spark, train_df, tmp_dir):
    res = TR.train_classifier(train_df, "text", "label", "id", grid=({"regParam": 0.01}, {"regParam": 1.0}),
                              max_iter=30, num_features=1 << 12)
    assert len(res.metrics) == 2 and res.params in ({"regParam": 0.01}, {"regParam": 1.0})
    best = max(res.metrics, key=lambda m: m["f1"])
    assert best["f1"] >= 0.95
    counts = {(r.label, r.split): r["count"] for r in res.split.groupBy("label", "split").count().collect()}
    assert counts[(2, "val")] == 40 and counts[(0, "val")] == 40
    labels = ["negative", "neutral", "positive"]
    pred = TR.predict(res.model, train_df, "text", labels)
    assert pred.count() == train_df.count()
    acc = pred.filter(((F.col("label") == 2) & (F.col("sentiment_label") == "positive")) |
                      ((F.col("label") == 0) & (F.col("sentiment_label") == "negative"))).count()
    assert acc / train_df.count() >= 0.95
    path = os.path.join(tmp_dir, "model")
    TR.save_model(res.model, path)
    scorer = create_scorer("trained", path=path, labels=labels)
    again = scorer.score(train_df, "text")
    cols = ["id", "sentiment_positive", "sentiment_negative", "sentiment_label"]
    assert again.select(cols).exceptAll(pred.select(cols)).count() == 0


def test_the_model_keeps_how_much_of_a_text_it_reads(spark, train_df, tmp_dir):
    res = TR.train_classifier(train_df, "text", "label", "id", grid=({"regParam": 0.01},), max_iter=10, num_features=1 << 10, max_tokens=4)
    TR.save_model(res.model, os.path.join(tmp_dir, "cut"))
    labels = ["negative", "neutral", "positive"]
    model = TR.load_model(os.path.join(tmp_dir, "cut"))
    longer = train_df.withColumn("text", F.concat("text", F.lit(" weak weak losses decline gloomy")))
    cols = ["id", "sentiment_positive", "sentiment_label"]
    a, b = (TR.predict(model, d, "text", labels).select(cols) for d in (train_df, longer))
    assert a.exceptAll(b).count() == 0
