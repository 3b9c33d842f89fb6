"""Registered queries: each binds operators to the driver's tables.

Every query reads whole tables (no id subsets, no row caps); a ``limit`` only
appears where it is the operator (top-k, sample). Doubles are rounded to 6
places and counts are BIGINT, matching the SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.functions.labels import argmax_label, softmax
from polarity.functions.text import (
    basic_clean, collapse_whitespace, compose_text, date_or, decode_label, encode_label,
    preprocess, preview, remove_stopwords, stopword_filter, tokenize, truncate_tokens, url_domain,
)
from polarity.operators import analytics as A
from polarity.operators import ranking as R
from polarity.operators import reshape as U
from polarity.operators import sampling as L
from polarity.operators import windows as W
from polarity.operators.joins import first_match_lookup
from polarity.operators.scoring import (
    KeywordModel, LexiconScorer, ModelScorer, add_lexicon_scores, compare_models, create_scorer, lexicon_scores,
    model_scores, score,
)
from polarity.plans import params as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CLASSES = ("positive", "negative", "neutral")


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from polarity.sources.tables import read_table
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """Round to 6 places; ``+ 0.0`` turns a negative zero into zero, so that
    both engines print and hash zero the same way."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# --------------------------------------------------------------------------
# shared building blocks


def doc_tokens(spark: SparkSession, sf_dir: str, *cols: str, stop: bool = True) -> DataFrame:
    """``documents`` with tokens of the cleaned text (T6, T7), stop words
    removed (T8) unless ``stop=False``."""
    docs = table(spark, sf_dir, "documents")
    toks = tokenize(basic_clean("text"))
    return docs.select("doc_id", *cols, (stopword_filter(toks) if stop else toks).alias("tokens"))


def scores_of(tokens: DataFrame, id_col: str, carry=(), prefix: str = "",
              with_compound: bool = False) -> DataFrame:
    return lexicon_scores(tokens, id_col, "tokens", P.QUERY_LEXICON,
                          P.QUERY_NEGATORS, P.QUERY_DEGREE, P.NEGATION_FACTOR, P.ALPHA,
                          carry=carry, prefix=prefix, with_compound=with_compound)


def doc_scores(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = (),
               prefix: str = "", with_compound: bool = False, stop: bool = True) -> DataFrame:
    """Lexicon scores of every document (one row per doc). ``stop=True`` is
    model A (processed text), ``stop=False`` model B (cleaned text only)."""
    toks = doc_tokens(spark, sf_dir, *carry, stop=stop)
    return scores_of(toks, "doc_id", carry, prefix, with_compound)


def two_models(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Wide table: model A (``a_*``, processed text) and model B (``b_*``,
    cleaned text with stop words) per document, scored in one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *carry, tokenize(basic_clean("text")).alias("_all"))
    toks = {"a_": stopword_filter("_all"), "b_": F.col("_all")}
    return add_lexicon_scores(docs, toks, P.QUERY_LEXICON, P.QUERY_NEGATORS, P.QUERY_DEGREE,
                              P.NEGATION_FACTOR, P.ALPHA).drop("_all")


def keyword_model():
    return KeywordModel(P.QUERY_KEYWORDS)


def keyword_scores(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", preprocess("text").alias("processed_text"))
    return model_scores(docs, "processed_text", keyword_model, P.LOGIT_LABELS, prefix).drop("processed_text")


def expected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected polarity from ``labels.quality``: 1 positive, 0 negative."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.when(F.col("quality") == 1, "positive")
                      .when(F.col("quality") == 0, "negative").alias("expected"))


# --------------------------------------------------------------------------
# scoring (M1, M2, M4, M8) and the flagship (A1)


@query("m1_lexicon_scores")
def q_m1_lexicon_scores(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, with_compound=True)
    return rounded(sc, ["positive", "negative", "neutral", "compound"])


@query("m1_large_lexicon")
def q_m1_large(spark, sf_dir):
    """M1 with a lexicon of all tokens of the documents, valued by their length."""
    from polarity.operators.scoring import hashed_lexicon_scores
    toks = doc_tokens(spark, sf_dir, stop=False)
    lexicon = toks.select(F.explode("tokens").alias("token")).distinct().withColumn("valence", (F.length("token") % 9 - 4) / F.lit(2.0))
    out = hashed_lexicon_scores(toks, F.col("tokens"), lexicon, P.QUERY_NEGATORS, P.QUERY_DEGREE, P.NEGATION_FACTOR, P.ALPHA, "", True)
    return rounded(out.drop("tokens"), ["positive", "negative", "neutral", "compound"])


@query("a1_mean_by_company")
def q_a1_mean_by_company(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, carry=("source",), prefix="sentiment_")
    out = A.mean_scores(sc, ["source"], prefix="sentiment_")
    return rounded(out.withColumnRenamed("source", "company"), CLASSES)


@query("m2_model_scores")
def q_m2_model_scores(spark, sf_dir):
    return rounded(keyword_scores(spark, sf_dir), CLASSES)


@query("m4_compare_models")
def q_m4_compare_models(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", preprocess("text").alias("processed_text"))
    models = {
        "lexicon": LexiconScorer(P.QUERY_LEXICON, P.QUERY_NEGATORS, P.QUERY_DEGREE,
                                 P.NEGATION_FACTOR, P.ALPHA, clean=False),
        "keyword": ModelScorer(keyword_model, P.LOGIT_LABELS),
    }
    return rounded(compare_models(docs, "processed_text", "doc_id", models), CLASSES)


def query_scorer(clean: bool = True, stop: bool = True) -> LexiconScorer:
    """The lexicon scorer of the queries: model A (``stop``) or B."""
    from polarity import resources
    return LexiconScorer(P.QUERY_LEXICON, P.QUERY_NEGATORS, P.QUERY_DEGREE, P.NEGATION_FACTOR, P.ALPHA,
                         stopwords=resources.english_stopwords() if stop else None, clean=clean)


def doc_dashboard(spark, sf_dir) -> dict[str, DataFrame]:
    """The dashboard over ``documents``: models A, B and the keyword model."""
    from polarity.plans.pipelines import dashboard
    docs = table(spark, sf_dir, "documents").select("doc_id", preprocess("text", remove_stops=False).alias("text"))
    models = {"a": query_scorer(clean=False), "b": query_scorer(clean=False, stop=False),
              "k": ProcessedModel(keyword_model, P.LOGIT_LABELS)}
    return dashboard(docs, "text", "doc_id", models, num_examples=P.SAMPLE_EXAMPLES, seed=P.SEED,
                     num_disagreements=P.TOP_DISAGREEMENTS)


class ProcessedModel(ModelScorer):
    """The keyword model on processed text (stop words removed)."""

    def score(self, df, text_col, id_col=None, prefix="sentiment_"):
        rows = df.withColumn("_processed", F.array_join(stopword_filter(tokenize(text_col)), " "))
        return super().score(rows, "_processed", id_col, prefix).drop("_processed")


@query("m8_side_by_side")
def q_m8_side_by_side(spark, sf_dir):
    cols = [f"{m}_{c}" for m in ("a", "b", "k") for c in CLASSES]
    return rounded(doc_dashboard(spark, sf_dir)["side_by_side"].drop("text"), cols)


@query("m8_distribution")
def q_m8_distribution(spark, sf_dir):
    return rounded(doc_dashboard(spark, sf_dir)["distribution"], ["pct"])


@query("m8_agreement")
def q_m8_agreement(spark, sf_dir):
    out = doc_dashboard(spark, sf_dir)
    both = out["agreement_b"].withColumn("model", F.lit("b")).unionByName(out["agreement_k"].withColumn("model", F.lit("k")))
    return rounded(both, ["agreement_pct"])


@query("m8_examples")
def q_m8_examples(spark, sf_dir):
    return doc_dashboard(spark, sf_dir)["examples"].select("doc_id", "a_label", "a_positive", "preview")


@query("m10_company_pipeline")
def q_m10_company_pipeline(spark, sf_dir):
    """News (documents, company = source) and posts (conversations, company =
    role) through the company pipeline."""
    from polarity.plans.pipelines import company_pipeline
    news = table(spark, sf_dir, "documents").select("text", F.col("source").alias("company"))
    posts = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"), F.col("role").alias("company"))
    out = company_pipeline(news, posts, query_scorer(clean=False, stop=False), sources="both")
    return rounded(A.mean_scores(out["scored"], ["source_type", "company"]), CLASSES)


@query("m10_collected")
def q_m10_collected(spark, sf_dir):
    """The company pipeline with all that it can collect by: search terms, days before a date, newest rows per company."""
    from polarity.plans.pipelines import company_pipeline
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    news = table(spark, sf_dir, "documents").select("text", date.alias("date"))
    out = company_pipeline(news, None, query_scorer(clean=False, stop=False), companies=P.PHRASES, days=P.LOOKBACK_DAYS, as_of=P.AS_OF, per_company=P.TOP_PER_COMPANY)
    scored = out["scored"].select("company", F.date_format("date", "yyyy-MM-dd").alias("day"), F.md5("text").alias("text_md5"),
                                  *(F.col(f"sentiment_{c}").alias(c) for c in CLASSES), F.col("sentiment_label").alias("label"))
    return rounded(scored, CLASSES)


@query("m3_score_documents")
def q_m3_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, "text", query_scorer())
    return rounded(out.drop("text"), [f"sentiment_{c}" for c in CLASSES])


@query("m3_score_conversations")
def q_m3_conversations(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = score(conv, "text", query_scorer())
    return rounded(out.drop("text"), [f"sentiment_{c}" for c in CLASSES])


@query("m9_score_if_needed")
def q_m9(spark, sf_dir):
    """Documents come unscored and are scored; scored rows pass unchanged."""
    from polarity.operators.scoring import score_if_needed
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, cols, label = score_if_needed(docs, "text", model=query_scorer())
    same, cols, label = score_if_needed(scored, "text", cols, label)
    return rounded(same.select("doc_id", *cols, label), cols)


@query("m5_scorer_by_name")
def q_m5(spark, sf_dir):
    """Scorers built by name through the registry, in any case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", preprocess("text").alias("text"))
    keyword = create_scorer("KeyWord", keywords=P.QUERY_KEYWORDS, labels=P.LOGIT_LABELS)
    lexicon = create_scorer("Lexicon", lexicon=P.QUERY_LEXICON, negators=P.QUERY_NEGATORS, degree=P.QUERY_DEGREE,
                            negation_factor=P.NEGATION_FACTOR, alpha=P.ALPHA, clean=False)
    return rounded(compare_models(docs, "text", "doc_id", {"lexicon": lexicon, "keyword": keyword}), CLASSES)


# --------------------------------------------------------------------------
# text functions


@query("t1_collapse_whitespace")
def q_t1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", collapse_whitespace("text").alias("text"))


@query("t2_url_domain")
def q_t2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_domain("url").alias("domain"))


@query("t6_clean_text")
def q_t6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", basic_clean("text").alias("clean_text"))


@query("t7_raw_tokens")
def q_t7_raw(spark, sf_dir):
    from polarity.operators.sentences import raw_words
    docs = table(spark, sf_dir, "documents").select("doc_id", raw_words(F.concat(F.lit('"It\'s '), "text", F.lit(' isn\'t" 1,000.5'))).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", "\n")).alias("words_md5"))


@query("t7_sentences")
def q_t7_sentences(spark, sf_dir):
    from polarity.operators.sentences import with_sentences
    out = with_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))


@query("t8_processed_text")
def q_t8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preprocess("text").alias("processed_text"))


@query("t8_custom_stopwords")
def q_t8_custom(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", remove_stopwords(basic_clean("text"), P.CUSTOM_STOPWORDS).alias("processed_text"))


@query("t9_lemmatize")
def q_t9(spark, sf_dir):
    from polarity.operators.lemma import lemma_frame, lemmatize
    docs = table(spark, sf_dir, "documents").select("doc_id", preprocess("text").alias("processed_text"))
    out = lemmatize(docs, "processed_text", lemma_frame(spark, P.QUERY_LEMMAS), "lemmatized_text")
    return out.select("doc_id", "lemmatized_text")


@query("t9_rule_lemmas")
def q_t9_rules(spark, sf_dir):
    """Processed texts with the lemmas that rules give and the documents' own words confirm."""
    from polarity.operators.preprocess import preprocess_dataframe
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = preprocess_dataframe(docs, "text", "done", lemmatize_text=True)
    return out.select("doc_id", F.md5("done").alias("lemmas_md5"), F.size(tokenize("done")).cast("long").alias("n_tokens"))


@query("t14_softmax_logits")
def q_t14(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    # every value of the vector is the logit of a class, named by its position
    logits = F.transform("embedding", lambda x: x.cast("double"))
    p = emb.select("vec_id", softmax(logits).alias("_p"))
    names = [str(i) for i in range(P.LOGIT_CLASSES)]
    return rounded(p.select("vec_id", F.array_max("_p").alias("top"), argmax_label("_p", names).alias("label"),
                            F.aggregate("_p", F.lit(0.0), lambda a, x: a + x * x).alias("sum_of_squares")), ["top", "sum_of_squares"])


@query("t15_truncate_tokens")
def q_t15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenize(basic_clean("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                       F.array_join(truncate_tokens("t", P.MAX_TOKENS), " ").alias("truncated_text"))


@query("t16_label_codec")
def q_t16(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    name = decode_label(F.col("quality") * 2, P.TRAIN_LABELS)
    return lab.select("doc_id", name.alias("label_name"),
                      encode_label(name, P.TRAIN_LABELS).cast("bigint").alias("label_id"))


@query("s1_normalise_articles")
def q_s1(spark, sf_dir):
    from polarity.sources.articles import normalise_articles
    """Article rows projected from documents: title = first line,
    description = the rest (null when none), published = derived day."""
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substr(text, char_length(substring_index(text, '\\n', 1)) + 2)")
    arts = docs.select(
        "doc_id", first.alias("title"), F.when(rest != "", rest).alias("description"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")),
                      "yyyy-MM-dd'T'10:00:00'Z'").alias("publishedAt"))
    return normalise_articles(arts).select("doc_id", F.md5("text").alias("text_md5"), F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("p7_preview")
def q_p7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("preview", preview("text", 100))
    toks = docs.select("doc_id", "preview", stopword_filter(tokenize(basic_clean("text"))).alias("tokens"))
    sc = scores_of(toks, "doc_id", ("preview",))
    return sc.select("doc_id", "preview", r6("positive").alias("positive"), "label")


# --------------------------------------------------------------------------
# aggregations


@query("a2_mean_by_source_type")
def q_a2(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    toks = conv.select("conv_id", "turn", "role",
                       stopword_filter(tokenize(basic_clean("text"))).alias("tokens"))
    sc = scores_of(toks, "conv_id", ("turn", "role"), "sentiment_")
    return rounded(A.mean_scores(sc, ["role"]).withColumnRenamed("role", "source_type"), CLASSES)


@query("a3_overall_mean")
def q_a3(spark, sf_dir):
    return rounded(A.overall_mean(doc_scores(spark, sf_dir), "positive", "mean_positive"), ["mean_positive"])


@query("a4_label_distribution")
def q_a4(spark, sf_dir):
    return rounded(A.label_distribution(doc_scores(spark, sf_dir), "label"), ["pct"])


@query("a5_agreement")
def q_a5(spark, sf_dir):
    return rounded(A.agreement(two_models(spark, sf_dir, ("lang",)), "a_label", "b_label", ["lang"]),
                   ["agreement_pct"])


@query("a6_accuracy")
def q_a6(spark, sf_dir):
    joined = doc_scores(spark, sf_dir).join(expected_labels(spark, sf_dir), "doc_id", "inner")
    clear = R.clear_cases(joined, "expected")
    return rounded(A.accuracy(clear, "label", "expected"), ["accuracy"])


@query("a7_classification_metrics")
def q_a7(spark, sf_dir):
    joined = doc_scores(spark, sf_dir).join(expected_labels(spark, sf_dir), "doc_id", "inner")
    return rounded(A.classification_metrics(joined, "expected", "label"),
                   ["accuracy", "precision", "recall", "f1"])


@query("a8_correlation")
def q_a8(spark, sf_dir):
    wide = two_models(spark, sf_dir, ("lang",))
    return rounded(A.correlation(wide, "a_positive", "b_positive", ["lang"]), ["pearson"])


@query("a9_mean_matrix")
def q_a9(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, carry=("source", "lang"))
    return rounded(A.mean_matrix(sc, "lang", "source", "positive"), ["mean_value"])


@query("a10_entity_matrix")
def q_a10(spark, sf_dir):
    means = q_a1_mean_by_company(spark, sf_dir).select("company", *CLASSES)
    return A.entity_matrix(means, "company", list(CLASSES))


@query("a11_box_stats")
def q_a11(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, prefix="sentiment_")
    long = U.melt_scores(sc, ["doc_id", "sentiment_label"], [f"sentiment_{c}" for c in CLASSES],
                         with_model=False)
    out = A.box_stats(long, ["score_type", "sentiment_label"], "score")
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"]) \
        .withColumnRenamed("sentiment_label", "label")


@query("a11_box_stats_balanced")
def q_a11_balanced(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, prefix="sentiment_")
    long = U.melt_scores(sc, ["doc_id", "sentiment_label"], [f"sentiment_{c}" for c in CLASSES],
                         with_model=False)
    out = A.box_stats(long, ["score_type", "sentiment_label"], "score", blocks=P.BOX_BLOCKS)
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"]) \
        .withColumnRenamed("sentiment_label", "label")


@query("a12_distinct_labels")
def q_a12(spark, sf_dir):
    return A.distinct_labels(doc_scores(spark, sf_dir), "label")


@query("a13_row_counts")
def q_a13(spark, sf_dir):
    return A.row_counts(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("a14_confidence")
def q_a14(spark, sf_dir):
    sc = doc_scores(spark, sf_dir)
    return rounded(A.mean_confidence(sc, list(CLASSES), ["label"]), ["mean_confidence", "min_confidence"])


# --------------------------------------------------------------------------
# windows (W1, W2), top-k and samples (L1-L5), filters (P5)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("w1_rolling_mean")
def q_w1(spark, sf_dir):
    ev = _events(spark, sf_dir)
    out = W.rolling_mean(ev, ["value"], P.ROLLING_ROWS, ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "user_id", "value_rolling"), ["value_rolling"])


@query("w1_rolling_mean_balanced")
def q_w1_balanced(spark, sf_dir):
    ev = _events(spark, sf_dir)
    out = W.rolling_mean_balanced(ev, ["value"], P.ROLLING_ROWS, ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "user_id", "value_rolling"), ["value_rolling"])


@query("w2_daily_rolling")
def q_w2(spark, sf_dir):
    ev = _events(spark, sf_dir)
    out = W.daily_series(ev, "ts", ["value"], ["event_type"], P.ROLLING_DAYS)
    out = out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return rounded(out, ["value", "value_rolling"])


@query("w2_incremental")
def q_w2_incremental(spark, sf_dir):
    """The daily series after three landings, of which each brings late days of the others."""
    import uuid
    from polarity.operators.states import add_landing, series
    from polarity.session import scratch_path
    ev, folder = _events(spark, sf_dir), scratch_path(spark, f"series-{uuid.uuid4().hex}")
    for batch in range(3):
        add_landing(ev.filter(F.pmod("event_id", F.lit(3)) == batch), folder, batch, "event_type", "ts", "value", P.ROLLING_DAYS)
    out = series(spark, folder).select(F.col("entity").alias("event_type"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("mean").alias("value"),
                                       F.col("n").alias("n_rows"), F.col("rolling").alias("value_rolling"))
    return rounded(out, ["value", "value_rolling"])


@query("a11_quantile_states")
def q_a11_states(spark, sf_dir):
    """Quartiles from sketches per type and day, merged for each type; whether their ranks are off by 1 % at most."""
    from polarity.operators.states import merge_quantiles, quantile_states, quantiles
    ev = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    states = quantile_states(ev, ["event_type", "day"], "value")
    ranks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles(merge_quantiles(states, ["event_type"]), ranks)
    rows = ev.filter("value IS NOT NULL").join(F.broadcast(found.drop("n")), "event_type")  # a row for each of a few types
    near = {c: (F.avg((F.col("value") < F.col(c)).cast("double")) <= r + 0.01) & (F.avg((F.col("value") <= F.col(c)).cast("double")) >= r - 0.01) for c, r in ranks.items()}
    checked = rows.groupBy("event_type").agg(*(x.alias(f"{c}_within_1_percent") for c, x in near.items()))
    return found.select("event_type", "n").join(checked, "event_type")


@query("l1_first_k_per_company")
def q_l1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"))
    out = L.first_k_per_group(docs, ["company"], ["doc_id"], P.TOP_PER_COMPANY, rank_col="position")
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("l2_top_disagreements")
def q_l2(spark, sf_dir):
    wide = two_models(spark, sf_dir)
    out = R.top_disagreements(wide, "a_label", "b_label", "doc_id", P.TOP_DISAGREEMENTS)
    return rounded(out.select("doc_id", "a_label", "b_label", "disagreement_score"), ["disagreement_score"])


@query("p5_disagreements")
def q_p5(spark, sf_dir):
    return R.disagreements(two_models(spark, sf_dir), "a_label", "b_label").select("doc_id", "a_label", "b_label")


@query("l3_stratified_sample")
def q_l3(spark, sf_dir):
    sc = doc_scores(spark, sf_dir)
    return L.stratified_sample(sc, "label", "doc_id", P.SAMPLE_EXAMPLES, P.SEED).select("doc_id", "label")


@query("l4_stratified_split")
def q_l4(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return L.stratified_split(lab, "quality", "doc_id", 0.2, P.SEED).select("doc_id", "quality", "split")


@query("l5_sort_by_date")
def q_l5(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    out = W.sort_by(ev, "ts_text", ["event_id"])
    return out.select("event_id", "ts_text", W.order_key(ev, "ts_text").cast("timestamp_ntz").alias("ts_parsed"))


# --------------------------------------------------------------------------
# reshape, joins and sources


@query("u1_union_sources")
def q_u1(spark, sf_dir):
    news = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", "source")
    posts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item_id"), "turn", F.col("text").alias("content"), "role")
    both = U.union_sources({"news": news, "posts": posts})
    # ``turn`` is null for news rows; as text it reads the same in every
    # client (a nullable integer turns into floats in some conversions)
    return both.select("source_type", "item_id", F.col("turn").cast("string").alias("turn"), "source", "role",
                       F.md5("text").alias("text_md5"))


@query("u3_melt_scores")
def q_u3(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, prefix="sentiment_")
    long = U.melt_scores(sc, ["doc_id"], [f"sentiment_{c}" for c in CLASSES])
    return rounded(long, ["score"])


@query("j1_author_lookup")
def q_j1(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = first_match_lookup(ev, cust, "user_id", "c_custkey")
    return out.select("event_id", "user_id", F.col("c_name").alias("username"), "c_mktsegment")


@query("s3_csv_round_trip")
def q_s3(spark, sf_dir):
    """S4 then S3: the whole documents table (multi-line texts, quotes)
    written as header CSV under the shared checkpoint folder and read back
    with its schema; the texts must come back unchanged."""
    import uuid
    from polarity.session import scratch_path
    from polarity.sources.files import read_text_csv, write_csv
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, f"csv-round-trip-{uuid.uuid4().hex}")
    write_csv(docs, path)
    back = read_text_csv(spark, path, "doc_id bigint, text string, source string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("s3_csv_split")
def q_s3_split(spark, sf_dir):
    """The documents as CSV whose texts hold line breaks and quotes, each file read in many tasks."""
    import uuid
    from polarity.session import scratch_path
    from polarity.sources.files import read_text_csv, write_csv
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit('"'), F.regexp_replace("text", r"\. ", '.\n"" ,"'), F.lit('"'))
    path = scratch_path(spark, f"csv-split-{uuid.uuid4().hex}")
    write_csv(docs.select("doc_id", text.alias("text"), "source"), path)
    back = read_text_csv(spark, path, "doc_id bigint, text string, source string", split=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("s5_page_articles")
def q_s5(spark, sf_dir):
    from polarity.sources.pages import parse_pages
    pages = table(spark, sf_dir, "pages")
    return parse_pages(pages).select("page_id", "domain", "title", "text")


@query("s7_mentions")
def q_s7(spark, sf_dir):
    from polarity.sources.filters import companies_frame, mentions
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    comp = companies_frame(spark, P.COMPANIES)
    return mentions(docs, "text", "doc_id", comp)


@query("s8_lookback")
def q_s8(spark, sf_dir):
    from polarity.sources.filters import lookback
    ev = _events(spark, sf_dir)
    return lookback(ev, "ts", P.AS_OF, P.LOOKBACK_DAYS).select("event_id", "user_id", "event_type")


@query("s8_overlapping_polls")
def q_s8_polls(spark, sf_dir):
    """Documents from three polls whose days overlap, the last of which also brings rows before the watermark."""
    import uuid
    from polarity.session import scratch_path
    from polarity.streaming.polls import collected, take_poll
    day = F.pmod("doc_id", F.lit(30)).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("at"), day.alias("d"))
    folder = scratch_path(spark, f"polls-{uuid.uuid4().hex}")
    for k, asked in enumerate(("d <= 14", "d BETWEEN 8 AND 22", "d >= 16 OR d <= 1")):
        poll = docs.filter(asked).drop("d")
        take_poll(poll.unionAll(poll), folder, k, "doc_id", "at", 10)
    rows, late = (collected(docs, folder, kind) for kind in ("rows", "rejects"))
    return (rows.select("doc_id", "text_md5", F.lit("new").alias("kind")).unionAll(late.select("doc_id", "text_md5", F.col("reason").alias("kind")))
            .groupBy("doc_id", "text_md5", "kind").agg(F.count("*").alias("n")))


@query("s9_url_list")
def q_s9(spark, sf_dir):
    from polarity.sources.articles import url_list
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([a-z]{2})/", 1).alias("company"),
        F.col("page_id").alias("position"), "url")
    out = url_list(pages, P.TOP_PER_COMPANY)
    return out.select("company", "position", "url")


# --------------------------------------------------------------------------
# training (M6): no SQL form; the driver checks rows only


@query("m6_train_classifier")
def q_m6(spark, sf_dir):
    from polarity.operators.training import predict, train_classifier
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2).alias("label"))
    data = docs.join(lab, "doc_id", "inner")
    res = train_classifier(data, "text", "label", "doc_id", grid=P.TRAIN_GRID, max_iter=20,
                           num_features=P.TRAIN_FEATURES, max_tokens=None)
    val = res.split.filter(F.col("split") == "val").select("doc_id", "text", "label")
    out = predict(res.model, val, "text", P.TRAIN_LABELS)
    return rounded(out.drop("text"), [f"sentiment_{c}" for c in CLASSES])


@query("m6_epochs")
def q_m6_epochs(spark, sf_dir):
    """M6 by epochs with M7 inside: rows of each part and class, how many get the same
    probabilities from the reloaded model, and whether the epochs keep the rules of early
    stop and best epoch."""
    import uuid
    from polarity.operators.epochs import EpochModel, train_epochs
    from polarity.session import scratch_path
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2).alias("label")), "doc_id")
    folder = scratch_path(spark, f"epochs-{uuid.uuid4().hex}")
    res = train_epochs(data, "text", "label", "doc_id", P.TRAIN_LABELS, folder, epochs=P.EPOCHS, batch_rows=P.EPOCH_BATCH, size=P.TRAIN_FEATURES)
    f1 = [m["f1"] for m in res.metrics]
    stop = next((k + 1 for k in range(len(f1)) if k - f1[:k + 1].index(max(f1[:k + 1])) >= 2), P.EPOCHS)
    ruled = [m["epoch"] for m in res.metrics] == list(range(1, stop + 1)) and res.best == f1.index(max(f1)) + 1
    res.model.save(spark, f"{folder}/model")
    part = data.join(res.split.select("doc_id", "split"), "doc_id")
    a, b = (m.predict(part, "text", f"{n}_") for n, m in (("a", res.model), ("b", EpochModel.load(spark, f"{folder}/model"))))
    both = a.join(b.drop("text", "label", "split"), "doc_id")
    same = F.col("a_label") == F.col("b_label")
    for c in CLASSES:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    counts = both.groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.count(F.when(same, 1)).alias("n_same_after_reload"))
    return counts.withColumns({"epochs_follow_the_rules": F.lit(ruled), "all_scores_in_range": F.lit(all(0 <= x <= 1 for x in f1))})


# --------------------------------------------------------------------------
# filters and preprocessing variants


@query("p4_filter_label")
def q_p4(spark, sf_dir):
    sc = doc_scores(spark, sf_dir, carry=("source",))
    return R.filter_equals(sc, "label", "positive").select("doc_id", "source", r6("positive").alias("positive"))


@query("t11_preprocess_lemmatized")
def q_t11(spark, sf_dir):
    from polarity.operators.lemma import lemma_frame
    from polarity.operators.preprocess import preprocess_dataframe
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = preprocess_dataframe(docs, "text", "processed_text", lemmatize_text=True,
                               lemma_table=lemma_frame(spark, P.QUERY_LEMMAS),
                               custom_stopwords=P.CUSTOM_STOPWORDS)
    return out.select("doc_id", "processed_text")


@query("t12_finance_stopwords")
def q_t12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", preprocess("text", extra_stopwords=P.EXTRA_STOPWORDS).alias("processed_text"))


# --------------------------------------------------------------------------
# saved responses (S1, S2), rejects (S6), constants and defaults (P1-P3),
# pasted scores (P6), unions (U2) and edge cases of the sources


def landed(responses: DataFrame) -> str:
    """Write responses as JSON lines under the shared folder."""
    import uuid
    from polarity.session import scratch_path
    path = scratch_path(responses.sparkSession, f"responses-{uuid.uuid4().hex}")
    responses.write.json(path)
    return path


def article_responses(spark, sf_dir) -> DataFrame:
    """Documents as saved search responses of 40 ids; every seventh was refused."""
    docs = table(spark, sf_dir, "documents").withColumn("page", F.floor(F.col("doc_id") / 40))
    article = F.struct(
        F.col("doc_id").alias("order"), F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id")).alias("url"),
        F.when(F.col("doc_id") % 11 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")),
                                                        "yyyy-MM-dd'T'23:30:00'Z'")).alias("publishedAt"))
    pages = docs.groupBy(F.col("source").alias("company"), "page").agg(F.array_sort(F.collect_list(article)).alias("articles"))
    return pages.select("company", F.when(F.col("page") % 7 == 6, "error").otherwise("ok").alias("status"),
                        F.transform("articles", lambda a: a.dropFields("order")).alias("articles"))


@query("s1_articles")
def q_s1_articles(spark, sf_dir):
    from polarity.sources.articles import articles
    arts, _ = articles(spark, landed(article_responses(spark, sf_dir)), multi_line=False)
    return arts.select("company", "url", "domain", "source_type", F.col("position").cast("bigint").alias("position"),
                       F.md5("text").alias("text_md5"), F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("s1_rejected_responses")
def q_s1_rejected(spark, sf_dir):
    from polarity.sources.articles import articles
    _, bad = articles(spark, landed(article_responses(spark, sf_dir)), multi_line=False)
    return bad.groupBy("company").agg(F.count("*").alias("n_rejected"), F.sum(F.size("articles")).alias("n_articles"))


@query("s2_posts")
def q_s2_posts(spark, sf_dir):
    """Conversations as saved post responses, one per conversation and role."""
    from polarity.sources.posts import posts
    conv = table(spark, sf_dir, "conversations")
    post = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when((F.col("conv_id") + F.col("turn")) % 10 == 0, F.concat(F.lit("RT @x: "), F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.concat(F.lit("2024-01-"), F.lpad(((F.col("conv_id") % 28) + 1).cast("string"), 2, "0"), F.lit("T12:00:00Z")).alias("created_at"),
        (F.col("turn") % 5).cast("long").alias("author_id"), F.when(F.col("conv_id") % 3 == 0, "fr").otherwise("en").alias("lang"))
    users = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("username")) for i, n in ((0, "zero"), (1, "one"), (1, "again"), (2, "two"))])
    responses = (conv.groupBy(F.col("role").alias("company"), "conv_id").agg(F.array_sort(F.collect_list(post)).alias("data"))
                 .select("company", "data", F.struct(users.alias("users")).alias("includes")))
    out = posts(spark, landed(responses), days=P.LOOKBACK_DAYS, as_of=P.AS_OF, multi_line=False)
    return out.select("id", F.md5("content").alias("content_md5"), F.date_format("date", "yyyy-MM-dd").alias("date"), "source", "company")


@query("s6_page_rejects")
def q_s6(spark, sf_dir):
    """Pages with some html missing: accepted and rejected rows by message."""
    from polarity.sources.pages import parse_pages, split_parsed
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 9 != 0, F.col("html")))
    good, bad = split_parsed(parse_pages(pages))
    return good.withColumn("error", F.lit("none")).select("page_id", "error").unionByName(bad.select("page_id", "error")) \
        .groupBy("error").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query("p1_normalised_posts")
def q_p1(spark, sf_dir):
    from polarity.sources.posts import normalise_posts
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit("2024-01-29T23:30:00-02:00").alias("created_at"), F.col("role").alias("company"))
    return normalise_posts(rows).select("id", F.md5("content").alias("content_md5"), F.date_format("date", "yyyy-MM-dd").alias("date"), "source", "company")


@query("p2_expected_columns")
def q_p2(spark, sf_dir):
    from polarity.sources.articles import EXPECTED
    out = U.ensure_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), EXPECTED, "")
    return out.select("doc_id", F.md5("text").alias("text_md5"), *[c for c in EXPECTED if c != "text"])


@query("p3_run_constants")
def q_p3(spark, sf_dir):
    return U.with_constants(table(spark, sf_dir, "labels").select("doc_id"), {"company": "ACME", "run_date": P.AS_OF})


@query("p6_paste_scores")
def q_p6(spark, sf_dir):
    base = doc_scores(spark, sf_dir, prefix="a_")
    other = doc_scores(spark, sf_dir, prefix="b_", stop=False)
    out = U.paste_scores(base, other, "doc_id")
    return rounded(out, [f"{m}_{c}" for m in ("a", "b") for c in CLASSES])


@query("u2_union_all")
def q_u2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = ("en", "de", "fr")
    parts = [docs.filter(F.col("lang") == x).select("doc_id", "lang", *more) for x, more in zip(named, (["source"], [], ["n_chars"]))]
    parts.append(docs.filter(~F.coalesce(F.col("lang").isin(*named), F.lit(False))).select("doc_id", "lang"))  # all others, and rows without a language
    out = U.union_all(parts)
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count("source").alias("n_source"), F.count("n_chars").alias("n_n_chars"))


@query("s3_csv_edge_texts")
def q_s3_edges(spark, sf_dir):
    """The CSV round trip with texts padded by blanks, emptied and nulled."""
    import uuid
    from polarity.session import scratch_path
    from polarity.sources.files import read_text_csv, write_csv
    docs = table(spark, sf_dir, "documents")
    text = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" \t ")))
            .when(F.col("doc_id") % 5 == 1, F.lit("")).when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.col("text")))
    path = scratch_path(spark, f"csv-edges-{uuid.uuid4().hex}")
    write_csv(docs.select("doc_id", text.alias("text")), path)
    back = read_text_csv(spark, path, "doc_id bigint, text string")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


@query("s7_mentions_phrases")
def q_s7_phrases(spark, sf_dir):
    from polarity.sources.filters import companies_frame, mentions
    return mentions(table(spark, sf_dir, "documents"), "text", "doc_id", companies_frame(spark, P.PHRASES))


@query("s7_many_companies")
def q_s7_many(spark, sf_dir):
    """Documents of each company among 20,000 terms; a company is known by all drawn pairs that begin with its word."""
    from polarity.sources.filters import mentions, words
    docs = table(spark, sf_dir, "documents")
    w = words(F.col("text"))
    pairs = docs.select(F.posexplode(F.arrays_zip(w.alias("company"), F.slice(w, F.lit(2), F.size(w)).alias("next"))).alias("i", "p"))
    pairs = pairs.filter(f"i % {P.TERM_STEP} = 0 AND p.next IS NOT NULL").selectExpr("p.company", "concat(p.company, ' ', p.next) AS term").distinct()
    comp = pairs.orderBy(F.md5("term"), "term").limit(P.COMPANY_TERMS)
    found = mentions(docs, "text", "doc_id", comp)
    return found.groupBy("company").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("doc_sum"))


@query("w1_rolling_mean_null_entity")
def q_w1_null(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("user_id", F.expr(f"nullif(user_id, {P.NULLED_USER})"))
    out = W.rolling_mean_balanced(ev, ["value"], P.ROLLING_ROWS, ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "value_rolling"), ["value_rolling"])
