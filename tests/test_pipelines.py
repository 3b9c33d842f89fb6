"""Pipelines (M8, M10) and incremental scoring, end to end in temp folders."""

import os

import pytest
from pyspark.sql import functions as F

from polarity.operators.scoring import KeywordModel, LexiconScorer, ModelScorer
from polarity.plans import pipelines as PL
from polarity.sources import articles as SA
from polarity.sources import posts as SO
from test_sources import article_landing, post_landing  # noqa: F401  (fixtures)

LEX = [("good", 1.9), ("ships", 1.0), ("new", 0.8), ("old", -0.5), ("body", 0.2)]


def test_company_pipeline(spark, article_landing, post_landing, tmp_dir):  # noqa: F811
    news, _ = SA.articles(spark, article_landing, as_of="2024-01-30")
    posts = SO.posts(spark, post_landing, days=7, as_of="2024-01-30")
    res = PL.company_pipeline(news, posts, LexiconScorer(LEX), sources="both", as_of="2024-01-30")
    scored = res["scored"]
    assert scored.count() == news.count() + posts.count()
    assert {"sentiment_positive", "sentiment_label", "processed_text", "source_type"} <= set(scored.columns)
    means = {r.company: r for r in res["means"].collect()}
    assert set(means) == {"ACME"} and means["ACME"].n_rows == scored.count()
    only_news = PL.company_pipeline(news, posts, LexiconScorer(LEX), sources="news")["scored"]
    assert only_news.count() == news.count()
    with pytest.raises(ValueError):
        PL.company_pipeline(news, posts, sources="radio")
    PL.write_company_outputs(res, tmp_dir, "20240130T000000")
    assert os.path.isdir(os.path.join(tmp_dir, "scored_20240130T000000", "company=ACME"))


def test_dashboard(spark, tmp_dir):
    rows = [(i, t) for i, t in enumerate(["good good news", "old bad news", "nothing", "new ships good",
                                           "old old", "", "good but old", "new body"])]
    df = spark.createDataFrame(rows, "id long, text string")
    models = {"lex": LexiconScorer(LEX),
              "kw": ModelScorer(lambda: KeywordModel([("good", "new"), ("old",), ("nothing",)]))}
    out = PL.dashboard(df, "text", "id", models, out_dir=os.path.join(tmp_dir, "dash"))
    wide = out["side_by_side"]
    assert wide.count() == len(rows)
    assert {"lex_positive", "lex_label", "kw_negative", "kw_label"} <= set(wide.columns)
    assert sum(r.n for r in out["distribution"].collect()) == len(rows)
    assert out["box"].count() > 0 and out["examples"].count() > 0
    assert 0 <= out["agreement_kw"].first().agreement_pct <= 100
    assert os.path.isdir(os.path.join(tmp_dir, "dash", "box"))
    lazy = PL.dashboard(df, "text", "id", models)
    cols = ["model", "score_type", "lex_label", "n", "q1", "median", "q3", "n_outliers"]
    assert lazy["box"].select(cols).exceptAll(out["box"].select(cols)).count() == 0
    plan = lazy["side_by_side"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    shown = out["examples"].first()
    assert shown.preview.endswith("...") and len(shown.lex_positive.split(".")[1]) == 4
    alone = PL.dashboard(df, "text", "id", models, compare=False, num_disagreements=None)
    assert "agreement_kw" not in alone and {r.model for r in alone["box"].collect()} == {"lex"}


def test_dashboard_starts_no_job_before_a_report_is_asked_for(spark):
    df = spark.createDataFrame([(1, "good"), (2, "old")], "id long, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "dashboard")
    out = PL.dashboard(df, "text", "id", {"lex": LexiconScorer(LEX), "b": LexiconScorer(LEX)})
    assert "box" in out and len(out) == 6 and not tracker.getJobIdsForGroup("lazy")
    assert out["distribution"].count() == 2 and tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_company_pipeline_collects(spark):
    rows = [("ACME", "good ACME news", "2024-01-29", "u1"), ("ACME", "bad acme news", "2024-01-28", "u1"), ("ACME", "nothing of it", "2024-01-29", "u2"),
            (None, "Big Blue and $ACME", "2024-01-30", "u3"), ("BLUE", "old big  blue", "2023-01-30", "u4"), ("BLUE", "good big blue", "2024-01-25", "u5")]
    news = spark.createDataFrame(rows, "company string, text string, date string, url string").withColumn("date", F.col("date").cast("date"))
    out = PL.company_pipeline(news, model=LexiconScorer(LEX), companies=[("ACME", "acme"), ("BLUE", "big blue")], days=7, as_of="2024-01-30")
    got = sorted((r.company, r.text) for r in out["scored"].collect())
    assert got == [("ACME", "Big Blue and $ACME"), ("ACME", "bad acme news"), ("ACME", "good ACME news"), ("BLUE", "Big Blue and $ACME"), ("BLUE", "good big blue")]
    top = PL.company_pipeline(news, model=LexiconScorer(LEX), companies=[("ACME", "acme"), ("BLUE", "big blue")], per_company=1)
    assert {(r.company, r.text) for r in top["scored"].collect()} == {("ACME", "Big Blue and $ACME"), ("BLUE", "Big Blue and $ACME")}
    with pytest.raises(ValueError):
        PL.company_pipeline(news, days=3)


def test_company_pipeline_scores_each_row_by_itself(spark):
    news = spark.createDataFrame([("A", "good"), ("A", "bad"), ("A", "good"), ("A", "table")], "company string, text string")
    got = sorted((r.text, r.sentiment_label, r.sentiment_neutral) for r in PL.company_pipeline(news, model=LexiconScorer([("good", 2.0), ("bad", -2.0)]))["scored"].collect())
    assert got == [("bad", "negative", 0.0), ("good", "positive", 0.0), ("good", "positive", 0.0), ("table", "neutral", 1.0)]


def test_stream_scoring_matches_batch(spark, tmp_dir):
    from polarity.streaming.scoring import score_batch, score_stream
    src = os.path.join(tmp_dir, "landing")
    first = spark.createDataFrame([(1, "good new"), (2, "old")], "id long, text string")
    first.write.parquet(os.path.join(src, "part1"))
    sink = os.path.join(tmp_dir, "scored")
    schema = first.schema
    q = score_stream(spark, os.path.join(src, "*"), schema, sink, model=LexiconScorer(LEX),
                     checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    spark.createDataFrame([(3, "ships good")], "id long, text string").write.parquet(os.path.join(src, "part2"))
    q = score_stream(spark, os.path.join(src, "*"), schema, sink, model=LexiconScorer(LEX),
                     checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    assert got.select("batch_id").distinct().count() == 2
    batch = score_batch(spark.read.parquet(os.path.join(src, "*")), "text", "id", LexiconScorer(LEX))
    cols = ["id", "sentiment_positive", "sentiment_negative", "sentiment_neutral", "sentiment_label"]
    assert got.select(cols).exceptAll(batch.select(cols)).count() == 0
