"""Lemmatisation with a dictionary ``(token, lemma)``, inside the row.

Texts are never exploded or shuffled. A short dictionary is written into the
plan (hash-set tests); a longer one is broadcast to Arrow batches; a table of
more than ``DICTIONARY_ROWS`` entries is looked up by a perfect hash (see
``rule_lemmas``). A token that the dictionary gives more than one
lemma takes the smallest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.operators.rule_lemmas import replace_tokens
from polarity.schemas import LEMMA, require_columns

PLAN_ROWS = 200
DICTIONARY_ROWS = 500_000


def lemma_frame(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame(list(pairs), LEMMA)


def dictionary(lemmas: DataFrame | Iterable[tuple[str, str]]) -> dict[str, str] | None:
    """The dictionary as a mapping; None for a table of more than ``DICTIONARY_ROWS`` rows."""
    if isinstance(lemmas, DataFrame):
        rows = lemmas.select("token", "lemma").limit(DICTIONARY_ROWS + 1).collect()
        if len(rows) > DICTIONARY_ROWS:
            return None
        lemmas = [tuple(r) for r in rows]
    out: dict[str, str] = {}
    for token, lemma in lemmas:
        if token is not None and lemma is not None:
            out[token] = min(lemma, out.get(token, lemma))
    return out


def lemmas_of(tokens: Column, lemmas: dict[str, str], spark: SparkSession | None = None) -> Column:
    """Tokens with each replaced by its lemma, others unchanged; null gives none."""
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    changed = {t: x for t, x in lemmas.items() if t != x}
    if not changed:
        return tokens
    if len(changed) <= PLAN_ROWS:
        by_lemma: dict[str, list[str]] = {}
        for t, x in changed.items():
            by_lemma.setdefault(x, []).append(t)

        def one(t: Column) -> Column:
            out = F
            for x, words in by_lemma.items():
                out = out.when(t.isin(words), F.lit(x))
            return F.when(t.isin(list(changed)), out).otherwise(t)

        return F.transform(tokens, one)
    shared = (spark or SparkSession.active()).sparkContext.broadcast(changed)

    @F.pandas_udf("array<string>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = shared.value.get
        for rows in batches:
            yield rows.map(lambda toks: [get(t, t) for t in toks])

    return look_up(tokens)


def lemmatize_tokens(df: DataFrame, tokens_col: str, lemmas: DataFrame | Iterable[tuple[str, str]],
                     out_col: str = "lemmas") -> DataFrame:
    """``df`` with ``out_col`` = tokens with each replaced by its lemma, in order."""
    require_columns(df, [tokens_col])
    known = dictionary(lemmas)
    if known is None:
        return replace_tokens(df, F.col(tokens_col), lemmas, out_col)
    return df.withColumn(out_col, lemmas_of(F.col(tokens_col), known, df.sparkSession))


def lemmatize(df: DataFrame, text_col: str, lemmas: DataFrame | Iterable[tuple[str, str]],
              out_col: str | None = None) -> DataFrame:
    """T9 on space-separated text: the input rows with ``out_col`` (default
    ``text_col``) lemmatised."""
    require_columns(df, [text_col])
    toks = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), " "), "")
    known, out_col = dictionary(lemmas), out_col or text_col
    if known is None:
        return replace_tokens(df, toks, lemmas, out_col).withColumn(out_col, F.array_join(out_col, " "))
    return df.withColumn(out_col, F.array_join(lemmas_of(toks, known, df.sparkSession), " "))
