"""Training a text classifier with Spark ML (M6), saving and loading it (M7),
and scoring with it through the scorer interface.

Fine-tuning a transformer is replaced by a distributed pipeline:
tokenise -> stop words -> hashed term frequencies -> IDF -> multinomial
logistic regression. The split is the exact stratified split (L4); the
best of a small parameter grid is chosen by weighted F1 (A7) on the
validation part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity import resources
from polarity.functions.text import basic_clean
from polarity.operators.analytics import classification_metrics
from polarity.operators.sampling import stratified_split
from polarity.operators.scoring import Scorer, register_scorer
from polarity.schemas import SCORE_CLASSES, require_columns

# Default grid (regularisation, elastic-net mix) and feature size.
DEFAULT_GRID = ({"regParam": 0.01, "elasticNetParam": 0.0},
                {"regParam": 0.1, "elasticNetParam": 0.0})
NUM_FEATURES = 1 << 16


def feature_stages(num_features: int = NUM_FEATURES, stopwords: Sequence[str] | None = None, max_tokens: int | None = None) -> list:
    """Tokens of the cleaned text -> stop words -> hashed counts -> IDF. With
    ``max_tokens`` a stage of the model keeps the first tokens (T15), so that
    training and prediction read the same part of a text."""
    tok = RegexTokenizer(inputCol="_clean", outputCol="_tok", pattern=" ", gaps=True, minTokenLength=1)
    cut = [SQLTransformer(statement=f"SELECT *, slice(_tok, 1, {int(max_tokens)}) AS _cut FROM __THIS__")] if max_tokens else []
    stop = StopWordsRemover(inputCol="_cut" if cut else "_tok", outputCol="_words",
                            stopWords=list(resources.english_stopwords() if stopwords is None else stopwords))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    return [tok, *cut, stop, tf, idf]


def classifier(label_col: str = "label", max_iter: int = 50, **params) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial",
                              maxIter=max_iter, **params)


def build_pipeline(text_col: str = "text", label_col: str = "label", max_iter: int = 50,
                   num_features: int = NUM_FEATURES, stopwords: Sequence[str] | None = None) -> Pipeline:
    """The whole pipeline (expects the ``_clean`` column of ``with_clean_text``)."""
    return Pipeline(stages=[*feature_stages(num_features, stopwords), classifier(label_col, max_iter)])


def with_clean_text(df: DataFrame, text_col: str, max_tokens: int | None = None) -> DataFrame:
    """The model input: cleaned text (T6), cut to ``max_tokens`` tokens."""
    clean = basic_clean(text_col)
    if max_tokens:
        clean = F.array_join(F.slice(F.split(clean, " "), 1, max_tokens), " ")
    return df.withColumn("_clean", clean)


@dataclass
class TrainResult:
    model: PipelineModel
    params: dict
    metrics: list[dict] = field(default_factory=list)
    split: DataFrame | None = None


def train_classifier(df: DataFrame, text_col: str, label_col: str, id_col: str,
                     grid: Sequence[dict] = DEFAULT_GRID, test_frac: float = 0.2, seed: int = 42,
                     max_tokens: int | None = None, max_iter: int = 50,
                     num_features: int = NUM_FEATURES) -> TrainResult:
    """M6: fit one pipeline per grid point on the train split, keep the one
    with the best weighted F1 on the validation split.

    The features are fitted and kept once for all grid points. Only the
    metric rows (one per grid point) reach the driver. Whole texts are read
    unless ``max_tokens`` is given, which the model then keeps.
    """
    require_columns(df, [text_col, label_col, id_col])
    data = df.select(id_col, text_col, F.col(label_col).cast("int").alias(label_col))
    # the split counts ids and labels, and marks the rows with a comparison
    split = stratified_split(data, label_col, id_col, test_frac, seed)
    train = with_clean_text(split.filter(F.col("split") == "train"), text_col)
    val = with_clean_text(split.filter(F.col("split") == "val"), text_col)
    # the features do not depend on the grid: fit them once, keep the
    # vectors of both parts while the classifiers are fitted, then release
    feats = Pipeline(stages=feature_stages(num_features, max_tokens=max_tokens)).fit(train)
    train_f = feats.transform(train).select(id_col, label_col, "_features").persist(StorageLevel.MEMORY_AND_DISK)
    val_f = feats.transform(val).select(id_col, label_col, "_features").persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    results = []
    try:
        for params in grid:
            lr_model = classifier(label_col, max_iter, **params).fit(train_f)
            pred = lr_model.transform(val_f).withColumn("_pred", F.col("prediction").cast("int"))
            m = classification_metrics(pred, label_col, "_pred").first().asDict()
            m.update(params)
            results.append(m)
            if best is None or m["f1"] > best[1]["f1"]:
                best = (lr_model, m, params)
    finally:
        train_f.unpersist()
        val_f.unpersist()
    model = PipelineModel(stages=[*feats.stages, best[0]])
    return TrainResult(model=model, params=best[2], metrics=results, split=split)


def predict(model: PipelineModel, df: DataFrame, text_col: str, labels: Sequence[str],
            prefix: str = "sentiment_", max_tokens: int | None = None) -> DataFrame:
    """Class probabilities as score columns + label; ``labels`` is the class
    order of the training labels (id -> name). Rows in = rows out."""
    data = with_clean_text(df, text_col, max_tokens)
    out = model.transform(data).withColumn("_p", vector_to_array("probability"))
    cols = {}
    for cls in SCORE_CLASSES:
        cols[f"{prefix}{cls}"] = (F.col("_p")[list(labels).index(cls)] if cls in labels
                                  else F.lit(None).cast("double"))
    names = F.array(*[F.lit(x) for x in labels])
    cols[f"{prefix}label"] = F.try_element_at(names, (F.col("prediction").cast("int") + 1))
    keep = [c for c in df.columns]
    return out.withColumns(cols).select(*keep, *cols.keys())


def save_model(model: PipelineModel, path: str) -> None:
    """M7: persist the fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


class TrainedScorer(Scorer):
    """A saved pipeline behind the scorer interface (registry name 'trained')."""

    name = "trained"

    def __init__(self, path: str | None = None, model: PipelineModel | None = None,
                 labels: Sequence[str] = ("negative", "neutral", "positive"), max_tokens: int | None = None):
        if model is None and path is None:
            raise ValueError("give a model or the path of a saved model")
        self.model = model or load_model(path)
        self.labels = list(labels)
        self.max_tokens = max_tokens

    def score(self, df, text_col, id_col=None, prefix="sentiment_"):
        return predict(self.model, df, text_col, self.labels, prefix, self.max_tokens)

    def scores(self, df, text_col, id_col, prefix):
        cols = [id_col] if id_col else []
        return self.score(df.select(*cols, text_col), text_col, id_col, prefix).drop(text_col)


register_scorer("trained", TrainedScorer)
