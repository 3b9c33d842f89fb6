"""Top-k per group (L1), stratified sample (L3) and exact split (L4)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from polarity.operators import sampling as L


def h(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    # unbalanced classes, one of them large
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c") for i in range(2000)]
    rows += [(2000 + i, None) for i in range(7)]
    return spark.createDataFrame(rows, "id long, label string"), rows


def test_first_k_per_group(labelled):
    df, rows = labelled
    out = L.first_k_per_group(df, ["label"], ["id"], 3, rank_col="rk").collect()
    got = sorted((r.label or "", r.id) for r in out)
    want = sorted((lab or "", i) for lab in ("a", "b", "c", None)
                  for i in sorted(i for i, x in rows if x == lab)[:3])
    assert got == want


def test_stratified_sample_rules(labelled):
    df, rows = labelled
    out = L.stratified_sample(df, "label", "id", num_examples=10, seed=42).collect()
    # 4 labels (null counted) -> 2 per named label, nulls never drawn
    assert len(out) == 6 and all(r.label is not None for r in out)
    for lab in ("a", "b", "c"):
        want = sorted((i for i, x in rows if x == lab), key=lambda i: (h(42, i), i))[:2]
        assert sorted(r.id for r in out if r.label == lab) == sorted(want)
    assert [r.label for r in out] == sorted(r.label for r in out)


def test_stratified_sample_fallback(spark):
    # more labels than examples: nothing per label, so a sample of all rows
    df = spark.createDataFrame([(i, f"l{i}") for i in range(30)], "id long, label string")
    out = L.stratified_sample(df, "label", "id", num_examples=5, seed=1).collect()
    want = sorted(range(30), key=lambda i: (h(1, i), i))[:5]
    assert sorted(r.id for r in out) == sorted(want)


def test_stratified_split_exact(labelled):
    df, rows = labelled
    out = L.stratified_split(df, "label", "id", test_frac=0.2, seed=42, bucket_digits=2)
    got = {r.id: r.split for r in out.collect()}
    assert len(got) == len(rows)
    for lab in ("a", "b", "c", None):
        ids = sorted((i for i, x in rows if x == lab), key=lambda i: (h(42, i), i))
        m = int(len(ids) * 0.2 + 0.5)
        assert [i for i in ids if got[i] == "val"] == ids[:m]


def test_split_repeatable(labelled):
    df, _ = labelled
    a = L.stratified_split(df, "label", "id")
    b = L.stratified_split(df, "label", "id")
    assert a.exceptAll(b).count() == 0
