"""Preprocess a text column of a DataFrame (T6 -> T8 -> T9)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.functions.text import preprocess, tokenize
from polarity.operators.lemma import lemmatize
from polarity.operators.rule_lemmas import rule_lemma_table
from polarity.schemas import require_columns


def preprocess_dataframe(df: DataFrame, text_column: str, new_column_name: str | None = None,
                         clean: bool = True, remove_stops: bool = True, lemmatize_text: bool = False,
                         lemma_table: DataFrame | Iterable[tuple[str, str]] | None = None,
                         custom_stopwords: Sequence[str] | None = None,
                         extra_stopwords: Iterable[str] = ()) -> DataFrame:
    """The input with ``new_column_name`` (default: ``text_column``
    itself) holding the processed text; ``ValueError`` when the column is
    missing. Lemmatisation takes a ``(token, lemma)`` dictionary; without one,
    lemmas come from rules that the texts' own words confirm (one aggregation
    over their tokens). It is off unless asked for. Texts stay in their rows.
    """
    require_columns(df, [text_column])
    out_col = new_column_name or text_column
    out = df.withColumn(out_col, preprocess(text_column, clean, remove_stops, custom_stopwords, extra_stopwords))
    if lemmatize_text:
        if lemma_table is None:
            lemma_table = rule_lemma_table(out, tokenize(out_col))
        out = lemmatize(out, out_col, lemma_table)
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))
