"""Training by epochs: against numpy on the same batches, resume, early stop, reload."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarity.operators import epochs as E
from polarity.operators.scoring import create_scorer

LABELS = ["negative", "neutral", "positive"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    words = {0: ["weak", "loss", "down"], 1: ["flat", "same", "steady"], 2: ["gain", "up", "strong"]}
    rows = []
    for i in range(900):
        y = r.randrange(3)
        rows.append((i, " ".join(r.choice([*words[y], *"abcdefgh"]) for _ in range(r.randrange(1, 14))), y))
    rows += [(5000, None, 1), (5001, "", 0), (None, "gain", 2), (5002, "gain", None)]
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(4)


def train(df, folder, **more):
    return E.train_epochs(df, "text", "label", "id", LABELS, folder, batch_rows=150, size=256, **more)


def test_weights_equal_numpy_on_the_same_batches(spark, data, tmp_dir):
    res = train(data, f"{tmp_dir}/a", epochs=3, patience=9)
    blocks = [(r["batch"], E._arrays(r)) for r in spark.read.parquet(f"{tmp_dir}/a/blocks").collect()]
    batches = max(b for b, _ in blocks) + 1
    assert batches == 5 and sum(len(x[0]) for _, x in blocks) == 902
    dense = {}
    for b, (labels, edges, features, values) in blocks:
        x = np.zeros((len(labels), 257))
        x[np.repeat(np.arange(len(labels)), np.diff(edges)), features] = values
        x[:, -1] = 1
        dense.setdefault(b, []).append((x, labels))
    w, m, v, step, f1 = np.zeros((3, 257)), 0, 0, 0, []
    for epoch in (1, 2, 3):
        for b in E.batch_order(batches, 42, epoch):
            x, y = np.concatenate([x for x, _ in dense[b]]), np.concatenate([y for _, y in dense[b]])
            z = np.exp(x @ w.T)
            g = (z / z.sum(1, keepdims=True) - np.eye(3)[y]).T @ x / len(y)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + 0.01 * np.c_[w[:, :-1], np.zeros(3)])
        x, y = np.concatenate([x for x, _ in dense[-1]]), np.concatenate([y for _, y in dense[-1]])
        f1.append((x @ w.T).argmax(1))
    last = E._states(spark, f"{tmp_dir}/a")[-1]
    assert np.allclose(np.frombuffer(last["weights"]).reshape(3, -1), w, atol=1e-10)
    assert [round(r["accuracy"], 6) for r in res.metrics] == [round(float((p == y).mean()), 6) for p in f1]
    assert res.metrics[-1]["f1"] > 0.8


def test_a_lost_run_goes_on_with_the_same_result(spark, data, tmp_dir, monkeypatch):
    whole = train(data, f"{tmp_dir}/whole", epochs=3, patience=9)
    train(data, f"{tmp_dir}/lost", epochs=1, patience=9)
    calls, real = [], E.gradient
    monkeypatch.setattr(E, "batch_order", lambda n, s, e, f=E.batch_order: calls.append(e) or f(n, s, e))
    again = train(data, f"{tmp_dir}/lost", epochs=3, patience=9)
    assert calls == [2, 3] and real is E.gradient
    assert np.allclose(again.model.weights, whole.model.weights, atol=1e-10) and again.best == whole.best


def test_early_stop_keeps_the_best_epoch(spark, data, tmp_dir, monkeypatch):
    scores = iter([0.5, 0.7, 0.7, 0.6, 0.9])

    class Metrics:
        def first(self):
            return self

        def asDict(self):  # noqa: N802
            return {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": next(scores)}

    monkeypatch.setattr(E, "classification_metrics", lambda *a: Metrics())
    res = train(data, f"{tmp_dir}/stop", epochs=5)
    assert [m["f1"] for m in res.metrics] == [0.5, 0.7, 0.7, 0.6] and res.best == 2
    assert np.array_equal(res.model.weights.ravel(), np.frombuffer(E._states(spark, f"{tmp_dir}/stop")[1]["weights"]))


def test_reload_and_scorer(spark, data, tmp_dir):
    res = train(data, f"{tmp_dir}/m", epochs=2, max_tokens=3)
    res.model.save(spark, f"{tmp_dir}/model")
    back = E.EpochModel.load(spark, f"{tmp_dir}/model")
    assert np.array_equal(back.weights, res.model.weights) and (back.labels, back.max_tokens) == (LABELS, 3)
    a, b = (create_scorer("epochs", model=m).score(data, "text", "id", "s_") for m in (res.model, back))
    assert set(a.columns) == {"id", "text", "label", "s_positive", "s_negative", "s_neutral", "s_label"}
    assert a.exceptAll(b).count() == 0 and a.count() == data.count()
    assert a.filter(F.abs(F.expr("s_positive + s_negative + s_neutral - 1")) > 1e-9).count() == 0
    more = data.withColumn("text", F.concat_ws(" ", "text", F.lit("x y z gain")))
    cut = back.predict(data.filter("size(split(text, ' ')) >= 3"), "text").select("id", "sentiment_label")
    assert cut.exceptAll(back.predict(more, "text").select("id", "sentiment_label")).count() == 0  # nothing after 3 tokens is read


def test_an_empty_table_has_no_epoch_to_learn_from(spark, data, tmp_dir):
    res = train(data.limit(0), f"{tmp_dir}/none", epochs=1)
    assert not res.model.weights.any() and res.split.count() == 0
