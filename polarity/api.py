"""The public API in one place."""

from polarity.functions.labels import argmax_label, label_from_compound, softmax  # noqa: F401
from polarity.functions.text import (  # noqa: F401
    basic_clean, collapse_whitespace, compose_text, date_or, decode_label, encode_label, preprocess,
    preview, remove_stopwords, stopword_filter, tokenize, tokenize_raw, truncate_tokens, url_domain,
)
from polarity.operators.analytics import (  # noqa: F401
    accuracy, agreement, box_stats, classification_metrics, confidence, confusion, correlation,
    distinct_labels, entity_matrix, label_distribution, mean_confidence, mean_matrix, mean_scores,
    overall_mean, row_counts,
)
from polarity.operators.joins import broadcast_checked, first_match_lookup  # noqa: F401
from polarity.operators.lemma import lemma_frame, lemmatize, lemmatize_tokens  # noqa: F401
from polarity.operators.preprocess import preprocess_dataframe  # noqa: F401
from polarity.operators.ranking import (  # noqa: F401
    clear_cases, disagreements, filter_equals, severity, top_disagreements,
)
from polarity.operators.reshape import (  # noqa: F401
    ensure_columns, melt_scores, paste_scores, union_all, union_sources, with_constants,
)
from polarity.operators.sampling import first_k_per_group, stratified_sample, stratified_split  # noqa: F401
from polarity.operators.scoring import (  # noqa: F401
    KeywordModel, add_lexicon_scores, LexiconScorer, ModelScorer, Scorer, analyze_text, available_scorers, compare_models,
    compare_models_on_text, create_scorer,
    lexicon_frame, lexicon_scores, model_scores, register_scorer, score,
    score_if_needed,
)
from polarity.operators.training import (  # noqa: F401
    TrainedScorer, load_model, predict, save_model, train_classifier,
)
from polarity.operators.windows import daily_series, rolling_mean, rolling_mean_balanced, sort_by  # noqa: F401
from polarity.plans.pipelines import company_pipeline, dashboard, write_company_outputs  # noqa: F401
from polarity.session import ensure_checkpoint_dir, get_session  # noqa: F401
from polarity.sources.articles import articles, normalise_articles, url_list  # noqa: F401
from polarity.sources.files import read_text_csv, write_csv, write_parquet  # noqa: F401
from polarity.sources.filters import lookback, mentions, mentions_one  # noqa: F401
from polarity.sources.pages import parse_pages, split_parsed  # noqa: F401
from polarity.sources.posts import english_original, normalise_posts, posts  # noqa: F401
from polarity.streaming.scoring import score_stream  # noqa: F401
