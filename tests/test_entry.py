"""The driver contract: entry, queries and their SQL twins."""

import os

import pytest

import __spark_entry__ as E
from paths import SF001

ROWS_ONLY = {"m6_train_classifier"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["company", "positive", "negative", "neutral", "n_rows"]


def test_every_query_has_sql_or_is_documented():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = {q for q in qs if not q.startswith("op") and q != "pipeline"}  # the others may be absent
    assert own - set(sql) == ROWS_ONLY


FAST = ["a1_mean_by_company", "m1_lexicon_scores", "a11_box_stats", "l4_stratified_split",
        "s5_page_articles", "w1_rolling_mean_balanced", "t6_clean_text", "m2_model_scores",
        "m3_score_documents", "m8_side_by_side", "m8_examples", "m10_company_pipeline", "t14_softmax_logits", "l3_stratified_sample"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    import duckdb
    sys_path = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import sys
    sys.path.insert(0, os.path.join(sys_path, "tools"))
    from check_oracle import rows_of
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = rows_of(E.queries()[name](spark, SF001).toPandas())
    want = rows_of(con.execute(E.oracle_sql()[name]).df())
    assert got == want
