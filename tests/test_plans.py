"""Plan shape: the physical plans are the ones the design promises."""

import pytest

from paths import SF01
from polarity.plans import catalog as C


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_exchanges(spark):
    plan = executed(C.QUERIES["a1_mean_by_company"](spark, SF01))
    # texts are scored where they are read: one scan, the final group-by, no join
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1
    assert "Join" not in plan and "Python" not in plan


def test_text_functions_stay_in_jvm(spark):
    for q in ("t6_clean_text", "t8_processed_text", "t15_truncate_tokens", "t2_url_domain", "t14_softmax_logits"):
        assert "Python" not in executed(C.QUERIES[q](spark, SF01)), q


def test_top_k_limits_before_shuffle(spark):
    plan = executed(C.QUERIES["l1_first_k_per_company"](spark, SF01))
    assert "WindowGroupLimit" in plan


def test_lemmas_and_scores_stay_in_the_row(spark):
    for q in ("t9_lemmatize", "t11_preprocess_lemmatized", "m3_score_documents", "m4_compare_models", "m8_side_by_side", "p7_preview"):
        plan = executed(C.QUERIES[q](spark, SF01))
        assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan parquet") == 1, q


def test_split_shuffles_ids_only(spark):
    from polarity.operators.sampling import stratified_split
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{SF01}/documents.parquet")
        plan = executed(stratified_split(docs, "lang", "doc_id"))
        assert "Exchange hashpartitioning" not in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_models_one_pass(spark):
    plan = executed(C.QUERIES["a5_agreement"](spark, SF01))
    assert plan.count("FileScan parquet") == 1


def test_model_scorer_no_shuffle_for_scoring(spark):
    plan = executed(C.QUERIES["m2_model_scores"](spark, SF01))
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan


def test_column_pruning_at_scan(spark):
    df = C.QUERIES["s8_lookback"](spark, SF01)
    plan = executed(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_side_by_side_one_scan_no_join(spark):
    plan = executed(C.QUERIES["m8_side_by_side"](spark, SF01))
    assert plan.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in plan and "ArrowEvalPython" in plan
