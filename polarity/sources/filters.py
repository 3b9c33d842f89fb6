"""Mention search (S7) and look-back window (S8) over stored text."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.schemas import require_columns
from polarity.sources.automaton import with_companies


def mentions_one(df: DataFrame, text_col: str, term: str) -> DataFrame:
    """S7 for one company: the term as a whole word, any case (also ``$TERM``)."""
    require_columns(df, [text_col])
    return df.filter(mentions_any(text_col, [term]))


def mentions_any(text_col: str, terms: Sequence[str]) -> F.Column:
    """True where the text holds one of the terms as whole words, in any case."""
    # a term may begin or end with a sign ($, .), where \b would never match
    found = "|".join(re.escape(t) for t in terms)
    return F.col(text_col).rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{found})(?![\p{{L}}\p{{N}}])")


def mentions(df: DataFrame, text_col: str, id_col: str, companies: DataFrame,
             company_col: str = "company", term_col: str = "term") -> DataFrame:
    """S7 for many companies: ``(id, company)`` for every text that holds a
    company's term as whole words, in any case.

    Texts and terms are split by the same rule (runs of letters and digits),
    so ``$AAPL``, "Goldman Sachs", ``BRK.B`` and ``3M`` are found. One automaton
    of all terms reads each text once (see ``automaton``); the distinct pairs
    come from a partial aggregation. A term without letters or digits matches
    nothing.
    """
    require_columns(df, [text_col, id_col])
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_words"))
    found = with_companies(texts, "_words", companies, company_col, term_col)
    return found.select(F.col("_id").alias(id_col), "company").distinct()


def words(text: F.Column) -> F.Column:
    """The words that mentions are searched in: lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def companies_frame(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "company string, term string")


def lookback(df: DataFrame, ts_col: str, as_of: str, days: int, cap: int | None = None) -> DataFrame:
    """Rows with ``ts`` in ``[as_of - days, as_of]`` (whole days).

    Bounds are literals, so the filter reaches the parquet scan; ``cap``
    limits ``days`` (7 for posts).
    """
    if cap is not None:
        days = min(days, cap)
    end = dt.date.fromisoformat(as_of) + dt.timedelta(days=1)
    start = dt.date.fromisoformat(as_of) - dt.timedelta(days=days)
    c = F.col(ts_col)
    dtype = df.schema[ts_col].dataType
    # bounds typed like the column, so that no cast lands on the column
    kind = "timestamp" if isinstance(dtype, T.TimestampType) else \
        "date" if isinstance(dtype, T.DateType) else "timestamp_ntz"
    lo = F.lit(start.isoformat()).cast(kind)
    hi = F.lit(end.isoformat()).cast(kind)
    return df.filter((c >= lo) & (c < hi))
