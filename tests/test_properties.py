"""Property-based checks on random inputs (hypothesis): text rules against
Python's own regex semantics, the lexicon job against brute force, the exact
split against a sort."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from polarity.functions import text as X
from polarity.operators import sampling as L
from polarity.operators import scoring as S
from test_scoring import DEG, LEX, NEG, brute
from test_text import py_clean

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

pieces = st.sampled_from(["good", "bad", "not", "very", "great", "flat", "x", "NEVER", "terrible", "slightly",
                          " ", "  ", "\t", " ", "　", ",", ".", "!", "@", "a@b", "http://u.rl/x",
                          "www.site.org", "12", "٣", "Ünï", "_", "'", "\n"])
texts = st.lists(st.lists(pieces, max_size=12).map(" ".join), min_size=1, max_size=25)


@SETTINGS
@given(texts)
def test_clean_equals_python(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id int, t string")
    got = {r.id: r.c for r in df.select("id", X.basic_clean("t").alias("c")).collect()}
    assert all(got[i] == py_clean(t) for i, t in enumerate(batch))


@SETTINGS
@given(texts)
def test_lexicon_equals_brute_force(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, t string")
    toks = {r.id: r.k for r in df.select("id", X.tokenize(X.basic_clean("t")).alias("k")).collect()}
    sc = {r.id: r for r in S.LexiconScorer(LEX, NEG, DEG).score(df, "t", None, "", with_compound=True).collect()}
    for i, t in toks.items():
        p, n, z, c, lab = brute(t)
        r = sc[i]
        assert (r.positive, r.negative, r.neutral, r.compound) == pytest.approx((p, n, z, c))
        assert r.label == lab


@SETTINGS
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=300),
       st.floats(min_value=0.0, max_value=1.0))
def test_split_exact(spark, labels, frac):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    got = {r.id: r.split for r in L.stratified_split(df, "label", "id", frac, 7, bucket_digits=1).collect()}
    for lab in set(labels):
        ids = sorted((i for i, x in enumerate(labels) if x == lab),
                     key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
        m = int(len(ids) * frac + 0.5)
        assert [i for i in ids if got[i] == "val"] == ids[:m]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.floats(-100, 100))), min_size=1, max_size=150),
       st.integers(1, 5), st.integers(1, 6))
def test_rolling_balanced_equals_pandas(spark, rows, n, blocks):
    import math

    import pandas as pd

    from polarity.operators.windows import rolling_mean_balanced
    data = [(i, e, i * 7 % 11, v) for i, (e, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, e int, t int, v double")
    got = {r.id: r.v_rolling for r in
           rolling_mean_balanced(df, ["v"], n, ["t", "id"], ["e"], blocks=blocks).collect()}
    pdf = pd.DataFrame(data, columns=["id", "e", "t", "v"]).astype({"v": "float64"})
    for _, g in pdf.sort_values(["t", "id"]).groupby("e"):
        for i, want in zip(g.id, g.v.rolling(n).mean()):
            if math.isnan(want):
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(want)
