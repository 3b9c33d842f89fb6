"""Scoring: rule-based lexicon scorer (M1), batch model scorer (M2), adding
score columns (M3), comparing models (M4), the registry (M5) and
score-if-needed (M9).

The lexicon scorer is a column expression: each token is paired with its
three predecessors inside the row, tokens outside the lexicon are filtered
out by a hash-set test, and the valences of the few hits are summed. A text
is scored where it is read: no id, no explode, no shuffle. A lexicon table of more
entries than a plan should hold is looked up by a broadcast perfect hash in
the same row, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity import resources
from polarity.functions.labels import argmax_label, label_from_compound, softmax
from polarity.functions.text import basic_clean, tokenize
from polarity.operators.large_lexicon import with_sums
from polarity.schemas import DEGREE, LEXICON, SCORE_CLASSES, require_columns

# Defaults of the lexicon scorer (parameters, not hard-coded in the rules).
NEGATION_FACTOR = 0.75
ALPHA = 15.0
CONTEXT = 3
# Entries of a lexicon table that are written into the plan; more are looked up by a
# perfect hash. Both score every row alike.
IN_PLAN_ENTRIES = 20_000


def lexicon_frame(spark: SparkSession, pairs: Iterable[tuple[str, float]] | None = None) -> DataFrame:
    """Lexicon table ``(token, valence)``; the seed lexicon by default."""
    rows = list(resources.seed_lexicon() if pairs is None else pairs)
    return spark.createDataFrame(rows, LEXICON)


def degree_frame(spark: SparkSession, pairs: Iterable[tuple[str, float]] | None = None) -> DataFrame:
    rows = list(resources.degree_words() if pairs is None else pairs)
    return spark.createDataFrame(rows, DEGREE)


def lexicon_rows(lexicon: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
    """One valence per token. Entries that repeat a token with the same
    valence count once; with another one they are an error."""
    seen: dict[str, float] = {}
    for token, valence in lexicon:
        if token is None or valence is None:
            continue
        if seen.setdefault(token, float(valence)) != float(valence):
            raise ValueError(f"the lexicon gives {token!r} more than one valence")
    return list(seen.items())


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body
    names it and wherever the optimizer moves the whole expression."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _value(valence: Column, previous: Sequence[Column], negators: Sequence[str],
           degree: Sequence[tuple[str, float]], negation_factor: float) -> Column:
    """Valence of a hit in its context: ``(val + sign(val) * degree) *
    (-factor if negated)``."""
    negated, degree_sum = F.lit(False), F.lit(0.0)
    for p in previous:
        if negators:
            negated = negated | F.coalesce(p.isin(list(negators)), F.lit(False))
        if degree:
            degree_sum = degree_sum + _lookup(p, degree, 0.0)
    scale = F.when(negated, F.lit(-float(negation_factor))).otherwise(F.lit(1.0))
    return (valence + F.signum(valence) * degree_sum) * scale


def _lookup(token: Column, pairs: Iterable[tuple[str, float]], default: float | None) -> Column:
    """Value of a token: one hash-set test per distinct value."""
    by_value: dict[float, list[str]] = {}
    for word, value in pairs:
        by_value.setdefault(float(value), []).append(word)
    out = None
    for value, words in by_value.items():
        hit = F.coalesce(token.isin(words), F.lit(False))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default).cast("double") if out is None else out.otherwise(F.lit(default).cast("double"))


def _sums(values: Column) -> Column:
    """``s`` (sum), ``p`` (sum of v + 1 over v > 0), ``n`` (sum of 1 - v over
    v < 0) and ``k`` (number of v != 0) of an array of valences."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).cast("long").alias("k"))
    return F.aggregate(values, zero, lambda a, v: F.struct(
        (a["s"] + v).alias("s"), (a["p"] + F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
        (a["n"] + F.when(v < 0, 1 - v).otherwise(0.0)).alias("n"),
        (a["k"] + F.when(v != 0, 1).otherwise(0)).alias("k")))


def _shares(sums: Column, n_tokens: Column, alpha: float, prefix: str, with_compound: bool) -> dict[str, Column]:
    """Output columns from the sums of a text."""
    S, P, N = sums["s"], sums["p"], sums["n"]
    Z = (n_tokens - sums["k"]).cast("double")
    total = P + N + Z
    compound = S / F.sqrt(S * S + F.lit(float(alpha)))
    share = lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))
    out = {f"{prefix}positive": share(P), f"{prefix}negative": share(N), f"{prefix}neutral": share(Z),
           f"{prefix}label": label_from_compound(compound)}
    if with_compound:
        out[f"{prefix}compound"] = compound
    return out


def add_lexicon_scores(df: DataFrame, tokens: dict[str, Column], lexicon: Iterable[tuple[str, float]],
                       negators: Sequence[str] | None = None,
                       degree: Sequence[tuple[str, float]] | None = None,
                       negation_factor: float = NEGATION_FACTOR, alpha: float = ALPHA,
                       with_compound: bool = False) -> DataFrame:
    """M1 in the row: ``df`` with ``{prefix}positive``, ``{prefix}negative``,
    ``{prefix}neutral`` and ``{prefix}label`` for every ``prefix`` key of
    ``tokens`` (e.g. the raw and the processed text).

    Rules (after the published rule-based social-media scorer of Hutto and
    Gilbert, 2014): a token's valence ``v`` comes from the lexicon (else 0);
    where ``v != 0``, degree words among the 3 preceding tokens add
    ``sign(v) * delta`` and a negator among them multiplies by
    ``-negation_factor``. ``S = sum(v)``, ``compound = S / sqrt(S^2 + alpha)``;
    ``P = sum(v + 1 | v > 0)``, ``N = sum(1 - v | v < 0)``, ``Z = #(v = 0)``
    and the shares are ``P, N, Z`` over ``P + N + Z``. No tokens: all shares 0,
    label neutral. Every row is scored by itself, whatever ids repeat.
    """
    pairs = [(w, v) for w, v in lexicon_rows(lexicon) if v != 0]
    words = [w for w, _ in pairs]
    negators = list(resources.negators() if negators is None else negators)
    degree = list(resources.degree_words() if degree is None else degree)

    def values(toks: Column) -> Column:
        """Valences of the hits, each in the context of the tokens before it."""
        if not words:
            return F.array().cast("array<double>")
        placed = F.transform(toks, lambda w, i: F.struct(w.alias("tok"), i.alias("i")))
        hits = F.filter(placed, lambda c: F.coalesce(c["tok"].isin(words), F.lit(False)))
        return F.transform(hits, lambda c: _value(
            _lookup(c["tok"], pairs, None), [F.get(toks, c["i"] - k) for k in range(1, CONTEXT + 1)], negators, degree, negation_factor))

    def scored(toks: Column) -> Column:
        return _once(_sums(values(toks)), lambda sums: F.struct(
            *[c.alias(n) for n, c in _shares(sums, F.size(toks), alpha, "", with_compound).items()]))

    out = df
    for i, (prefix, toks) in enumerate(tokens.items()):
        one = _once(F.coalesce(toks, F.array().cast("array<string>")), scored)
        names = [*SCORE_CLASSES, "label"] + (["compound"] if with_compound else [])
        out = out.withColumn(f"_scores{i}", one)
        out = out.withColumns({f"{prefix}{n}": F.col(f"_scores{i}")[n] for n in names}).drop(f"_scores{i}")
    return out


def lexicon_scores(df: DataFrame, id_col: str, tokens: str | Column, lexicon: DataFrame | Iterable[tuple[str, float]],
                   negators: Sequence[str] | None = None,
                   degree: Sequence[tuple[str, float]] | None = None,
                   negation_factor: float = NEGATION_FACTOR, alpha: float = ALPHA,
                   carry: Sequence[str] = (), prefix: str = "sentiment_",
                   with_compound: bool = False) -> DataFrame:
    """M1: ``id_col``, the ``carry`` columns and the scores of each row.

    Each row is scored by itself, whatever ids repeat. Pairs and short tables
    are written into the plan (:func:`add_lexicon_scores`), longer tables are
    looked up by a perfect hash (:mod:`polarity.operators.large_lexicon`).
    """
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    names = [f"{prefix}{c}" for c in (*SCORE_CLASSES, "label")] + ([f"{prefix}compound"] if with_compound else [])
    pairs = small_lexicon(lexicon)
    if pairs is not None:
        rows = df.select(id_col, *carry, tok.alias("_tokens"))
        done = add_lexicon_scores(rows, {prefix: F.col("_tokens")}, pairs, negators, degree, negation_factor, alpha, with_compound)
        return done.select(id_col, *carry, *names)

    rows = df.select(id_col, *carry, tok.alias("_tok"))
    done = hashed_lexicon_scores(rows, F.col("_tok"), lexicon, negators, degree, negation_factor, alpha, prefix, with_compound)
    return done.select(id_col, *carry, *names)


def hashed_lexicon_scores(df: DataFrame, tokens: Column, lexicon: DataFrame, negators: Sequence[str] | None = None,
                          degree: Sequence[tuple[str, float]] | None = None, negation_factor: float = NEGATION_FACTOR,
                          alpha: float = ALPHA, prefix: str = "sentiment_", with_compound: bool = False) -> DataFrame:
    """M1 in the row for a lexicon table of any size: ``df`` with the score columns."""
    negators = list(resources.negators() if negators is None else negators)
    degree = list(resources.degree_words() if degree is None else degree)
    out = with_sums(df, tokens, lexicon, negators, degree, negation_factor, CONTEXT)
    shares = _shares(F.col("_sums"), F.col("_n_tokens"), alpha, prefix, with_compound)
    return out.withColumns(shares).drop("_sums", "_n_tokens")


def small_lexicon(lexicon: DataFrame | Iterable[tuple[str, float]]) -> list[tuple[str, float]] | None:
    """The entries of a lexicon that fits a plan; None for a larger table."""
    if not isinstance(lexicon, DataFrame):
        return lexicon_rows(lexicon)
    rows = lexicon.select("token", F.col("valence").cast("double")).limit(IN_PLAN_ENTRIES + 1).collect()
    return lexicon_rows([tuple(r) for r in rows]) if len(rows) <= IN_PLAN_ENTRIES else None


# ---------------------------------------------------------------------------
# M2: batch model scoring in Arrow batches


class KeywordModel:
    """A small deterministic model: logit of a class = number of the text's
    tokens (split on spaces) found in the class keyword set.

    It stands in for a neural classifier (no weights can be loaded offline)
    and has the same interface: ``__call__(texts) -> ndarray (n, k)``.
    """

    def __init__(self, keywords: Sequence[Sequence[str]]):
        self.keywords = [frozenset(k) for k in keywords]

    def __call__(self, texts: pd.Series):
        import numpy as np
        toks = texts.fillna("").reset_index(drop=True).str.split(" ").explode()
        out = np.zeros((len(texts), len(self.keywords)), dtype="float64")
        for k, kw in enumerate(self.keywords):
            hits = toks.isin(kw).groupby(level=0).sum()
            out[:, k] = hits.reindex(range(len(texts)), fill_value=0).to_numpy(dtype="float64")
        return out


def length_batches(lengths: Sequence[int], token_budget: int, batch_size: int | None = None) -> list[list[int]]:
    """Places of texts in batches of similar length: the longest first, as many a
    batch as fill ``token_budget`` when all are as long as the longest (one at least)."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out, at = [], 0
    while at < len(order):
        n = max(1, token_budget // max(lengths[order[at]], 1))
        n = min(n, batch_size) if batch_size else n
        out.append(order[at:at + n])
        at += n
    return out


# Texts and characters that a task holds at most to form batches by length.
BUFFER_ROWS = 4096
BUFFER_CHARS = 16 << 20


def model_logits(text: str | Column, model_factory: Callable[[], Callable], n_classes: int,
                 batch_size: int | None = 16, token_budget: int | None = None) -> Column:
    """Logits ``ARRAY<DOUBLE>`` from a user model, evaluated by an iterator
    pandas UDF: only the text column crosses to Python and the model is built
    once per task. It is fed ``batch_size`` texts at a time, in order; with
    ``token_budget`` it gets batches of texts of similar length (words), formed in
    a buffer of ``BUFFER_ROWS`` texts, whose padded size stays under the budget. The
    last value of each array is then the share of padding in the text's batch."""

    def scored(model, texts: pd.Series):
        import numpy as np
        texts = texts.reset_index(drop=True)
        if token_budget is None:
            parts = [np.asarray(model(texts.iloc[s:s + batch_size]), dtype="float64").reshape(-1, n_classes) for s in range(0, len(texts), batch_size)]
            return np.concatenate(parts) if parts else np.zeros((0, n_classes))
        lengths = texts.fillna("").str.split().str.len().tolist()
        out = np.zeros((len(texts), n_classes + 1))
        for places in length_batches(lengths, token_budget, batch_size):
            slots = max(lengths[places[0]], 1) * len(places)
            out[places, :-1] = np.asarray(model(texts.iloc[places]), dtype="float64").reshape(len(places), n_classes)
            out[places, -1] = 1 - sum(lengths[i] for i in places) / slots
        return out

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        held, rows, chars = [], 0, 0
        for texts in batches:
            if token_budget is None:
                yield pd.Series(list(scored(model, texts)))
                continue
            held.append(texts)
            rows, chars = rows + len(texts), chars + int(texts.str.len().fillna(0).sum())
            if rows >= BUFFER_ROWS or chars >= BUFFER_CHARS:
                yield pd.Series(list(scored(model, pd.concat(held))))
                held, rows, chars = [], 0, 0
        if held:
            yield pd.Series(list(scored(model, pd.concat(held))))

    return _logits(F.col(text) if isinstance(text, str) else text)


def model_scores(df: DataFrame, text_col: str, model_factory: Callable[[], Callable],
                 labels: Sequence[str] = SCORE_CLASSES, prefix: str = "sentiment_",
                 batch_size: int | None = 16, keep_logits: bool = False, token_budget: int | None = None) -> DataFrame:
    """M2: soft-max shares per class + arg-max label, added next to the input.

    ``labels`` is the class order of the model's logits (a property of the
    model). Rows in = rows out; no shuffle. ``token_budget`` forms batches by
    length (``model_logits``) and adds ``{prefix}padded``, the share of padding in
    a text's batch.
    """
    require_columns(df, [text_col])
    lg = f"{prefix}logits"
    probs = f"{prefix}_probs"
    out = df.withColumn(lg, model_logits(text_col, model_factory, len(labels), batch_size, token_budget))
    if token_budget is not None:
        out = out.withColumns({f"{prefix}padded": F.element_at(lg, -1), lg: F.slice(lg, 1, len(labels))})
    out = out.withColumn(probs, softmax(lg))
    cols = {}
    for cls in SCORE_CLASSES:
        cols[f"{prefix}{cls}"] = (F.col(probs)[labels.index(cls)] if cls in labels
                                  else F.lit(None).cast("double"))
    cols[f"{prefix}label"] = argmax_label(probs, labels)
    out = out.withColumns(cols).drop(probs)
    return out if keep_logits else out.drop(lg)


# ---------------------------------------------------------------------------
# Scorers, registry (M5) and M3/M4/M9


class Scorer:
    """Adds ``{prefix}positive|negative|neutral|label`` to a DataFrame."""

    name = "scorer"

    def score(self, df: DataFrame, text_col: str, id_col: str | None = None,
              prefix: str = "sentiment_") -> DataFrame:
        raise NotImplementedError


class LexiconScorer(Scorer):
    """M1 behind the scorer interface. Texts are cleaned (T6) and split
    first; cleaning is idempotent, so processed text may be passed too. Rows
    are scored in place; only a lexicon table of more than
    ``PLAN_LEXICON_ROWS`` rows needs a unique id column."""

    name = "lexicon"

    def __init__(self, lexicon: Sequence[tuple[str, float]] | DataFrame | None = None,
                 negators: Sequence[str] | None = None,
                 degree: Sequence[tuple[str, float]] | None = None,
                 negation_factor: float = NEGATION_FACTOR, alpha: float = ALPHA,
                 stopwords: Sequence[str] | None = None, clean: bool = True):
        self.clean = clean
        self.lexicon = resources.seed_lexicon() if lexicon is None else lexicon
        self.pairs = small_lexicon(self.lexicon)
        self.negators = negators
        self.degree = degree
        self.negation_factor = negation_factor
        self.alpha = alpha
        self.stopwords = stopwords

    def tokens(self, text_col: str) -> Column:
        """Tokens of the text: cleaned (T6) and split (T7); with
        ``clean=False`` the text is taken as already processed."""
        toks = tokenize(basic_clean(text_col) if self.clean else F.coalesce(F.col(text_col), F.lit("")))
        if self.stopwords is not None:
            toks = F.filter(toks, lambda t: ~t.isin(list(self.stopwords)))
        return toks

    def score(self, df, text_col, id_col=None, prefix="sentiment_", with_compound=False):
        require_columns(df, [text_col] + ([id_col] if id_col else []))
        if self.pairs is not None:
            return add_lexicon_scores(df, {prefix: self.tokens(text_col)}, self.pairs, self.negators, self.degree,
                                      self.negation_factor, self.alpha, with_compound)
        return hashed_lexicon_scores(df, self.tokens(text_col), self.lexicon, self.negators, self.degree,
                                     self.negation_factor, self.alpha, prefix, with_compound)


class ModelScorer(Scorer):
    """M2 behind the scorer interface (no id needed, no shuffle)."""

    name = "model"

    def __init__(self, model_factory: Callable[[], Callable], labels: Sequence[str] = SCORE_CLASSES,
                 batch_size: int | None = 16, token_budget: int | None = None):
        self.model_factory = model_factory
        self.labels = list(labels)
        self.batch_size = batch_size
        self.token_budget = token_budget

    def score(self, df, text_col, id_col=None, prefix="sentiment_"):
        return model_scores(df, text_col, self.model_factory, self.labels, prefix, self.batch_size, token_budget=self.token_budget)


_REGISTRY: dict[str, Callable[..., Scorer]] = {}
DEFAULT_SCORER = "lexicon"


def register_scorer(name: str, factory: Callable[..., Scorer]) -> None:
    _REGISTRY[name.lower()] = factory


def available_scorers() -> list[str]:
    return sorted(_REGISTRY)


def create_scorer(name: str | None = None, **kwargs) -> Scorer:
    """M5: scorer by name (case-insensitive); ``ValueError`` lists valid names."""
    key = (name or DEFAULT_SCORER).lower()
    if key not in _REGISTRY:
        raise ValueError(f"no scorer is registered as {key!r}; registered: {', '.join(available_scorers())}")
    return _REGISTRY[key](**kwargs)


register_scorer("lexicon", LexiconScorer)
register_scorer("keyword", lambda keywords=(("good",), ("bad",), ()), labels=SCORE_CLASSES, **kw:
                ModelScorer(lambda: KeywordModel(keywords), labels, **kw))


def _as_scorer(model: str | Scorer | None) -> Scorer:
    return model if isinstance(model, Scorer) else create_scorer(model)


def score(df: DataFrame, text_col: str, model: str | Scorer | None = None,
          id_col: str | None = None, prefix: str = "sentiment_") -> DataFrame:
    """M3: the input with four score columns added. Missing column: ValueError."""
    require_columns(df, [text_col])
    return _as_scorer(model).score(df, text_col, id_col, prefix)


def compare_models(df: DataFrame, text_col: str, id_col: str,
                   models: dict[str, str | Scorer]) -> DataFrame:
    """M4: long form ``(id, model, positive, negative, neutral, label)``;
    rows out = rows in x models.

    The input is read once: every scorer adds its columns to the rows, and one
    explode gives the long form.
    """
    require_columns(df, [text_col, id_col])
    scorers = {n: _as_scorer(m) for n, m in models.items()}
    out = df.select(id_col, text_col)
    for name, sc in scorers.items():
        out = sc.score(out, text_col, id_col, f"_{name}_")
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), *[F.col(f"_{n}_{c}").alias(c) for c in (*SCORE_CLASSES, "label")])
        for n in scorers]))
    return out.select(id_col, rows.alias("_r")).select(id_col, "_r.*")


def analyze_text(spark: SparkSession, text: str, model: str | Scorer | None = None) -> dict:
    """One text as a one-row table: ``{positive, negative, neutral, label}``."""
    one = spark.createDataFrame([(0, text)], "id long, text string")
    row = _as_scorer(model).score(one, "text", "id", "").first()
    return {c: row[c] for c in (*SCORE_CLASSES, "label")}


def compare_models_on_text(spark: SparkSession, text: str,
                           models: dict[str, str | Scorer] | None = None) -> dict[str, dict]:
    """M4 for one text: model name -> score record (default: every
    registered scorer that needs no arguments)."""
    models = models or {"lexicon": "lexicon", "keyword": "keyword"}
    one = spark.createDataFrame([(0, text)], "id long, text string")
    return {r["model"]: {c: r[c] for c in (*SCORE_CLASSES, "label")}
            for r in compare_models(one, "text", "id", models).collect()}


def score_if_needed(df: DataFrame, text_col: str = "text",
                    sentiment_columns: Sequence[str] | None = None,
                    label_column: str | None = None, model: str | Scorer | None = None,
                    id_col: str | None = None) -> tuple[DataFrame, list[str], str]:
    """M9: pass through when both score columns and label column are given,
    else score; then check that all named columns exist."""
    if sentiment_columns is None or label_column is None:
        df = score(df, text_col, model, id_col, "sentiment_")
        sentiment_columns = [f"sentiment_{c}" for c in SCORE_CLASSES]
        label_column = "sentiment_label"
    require_columns(df, [text_col, *sentiment_columns, label_column])
    return df, list(sentiment_columns), label_column

