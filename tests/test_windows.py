"""Rolling means (W1, W2) and date sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polarity.operators import windows as W


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    n = 3000
    # one entity holds about a third of all rows (a hot key)
    users = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30 * 86400, n), unit="s")
    vals = rng.random(n) * 100
    vals[rng.random(n) < 0.03] = np.nan  # a few missing values inside frames
    pdf = pd.DataFrame({"event_id": np.arange(n), "user_id": users, "ts": ts, "value": vals})
    df = spark.createDataFrame(pdf.astype({"value": "float64"})).withColumn(
        "value", F.when(F.isnan("value"), None).otherwise(F.col("value")))
    return df, pdf


def expected_rolling(pdf, n):
    out = {}
    for _, g in pdf.sort_values(["ts", "event_id"]).groupby("user_id"):
        r = g["value"].rolling(n).mean()  # full frame: all n values present
        out.update(dict(zip(g.event_id, r)))
    return out


@pytest.mark.parametrize("balanced", [False, True])
def test_rolling_mean_full_frame(series, balanced):
    df, pdf = series
    fn = W.rolling_mean_balanced if balanced else W.rolling_mean
    kw = {"blocks": 7} if balanced else {}
    got = {r.event_id: r.value_rolling for r in
           fn(df, ["value", "missing_col"], 4, ["ts", "event_id"], ["user_id"], **kw).collect()}
    want = expected_rolling(pdf, 4)
    assert len(got) == len(want)
    for k, v in want.items():
        if np.isnan(v):
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v), k


def test_rolling_single_series_balanced(series):
    df, pdf = series
    got = {r.event_id: r.value_rolling for r in
           W.rolling_mean_balanced(df, ["value"], 3, ["ts", "event_id"], [], blocks=5).collect()}
    want = pdf.sort_values(["ts", "event_id"])
    want = dict(zip(want.event_id, want["value"].rolling(3).mean()))
    for k, v in want.items():
        assert (got[k] is None) if np.isnan(v) else got[k] == pytest.approx(v)


def test_rolling_requires_partition(series):
    df, _ = series
    with pytest.raises(ValueError):
        W.rolling_mean(df, ["value"], 3, ["ts"], [])


def test_daily_series(series):
    df, pdf = series
    daily = W.daily_series(df, "ts", ["value"], ["user_id"], rolling_days=2)
    want = pdf.assign(date=pdf.ts.dt.date).groupby(["user_id", "date"])["value"].mean()
    got = {(r.user_id, r.date): r.value for r in daily.collect()}
    assert len(got) == len(want)
    for k, v in want.items():
        assert (got[k] is None) if np.isnan(v) else got[k] == pytest.approx(v)


def test_sort_by_parses_strings(spark):
    df = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2023-12-31 10:00:00"), (3, "bad")],
                               "id int, d string")
    assert [r.id for r in W.sort_by(df, "d", ["id"]).collect()] == [2, 1, 3]


def test_balanced_rolling_mean_of_a_null_entity(spark):
    rows = [(None if k % 3 == 0 else "a", k, float(k * k % 17)) for k in range(100)]
    df = spark.createDataFrame(rows, "e string, t int, x double")
    a = W.rolling_mean(df, ["x"], 5, ["t"], ["e"])
    b = W.rolling_mean_balanced(df, ["x"], 5, ["t"], ["e"], blocks=7)
    assert a.exceptAll(b.select(a.columns)).count() == 0
