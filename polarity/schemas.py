"""Explicit schemas and plan-time column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCORE_CLASSES = ("positive", "negative", "neutral")


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "DataFrame") -> None:
    """Raise ``ValueError`` at plan time when a column is missing."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        raise ValueError(f"Column(s) {missing} not found in {what}; have {df.columns}")


def score_columns(prefix: str = "sentiment_") -> list[str]:
    return [f"{prefix}{c}" for c in SCORE_CLASSES] + [f"{prefix}label"]


SCORE_STRUCT = T.StructType([
    T.StructField("positive", T.DoubleType()),
    T.StructField("negative", T.DoubleType()),
    T.StructField("neutral", T.DoubleType()),
    T.StructField("label", T.StringType()),
])

# Saved response of the article search API (one JSON document per file).
ARTICLE_RESPONSE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("articles", T.ArrayType(T.StructType([
        T.StructField("source", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("name", T.StringType()),
        ])),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("publishedAt", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])

# Saved response of the post search API.
POST_RESPONSE = T.StructType([
    T.StructField("company", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("public_metrics", T.StructType([
            T.StructField("like_count", T.LongType()),
            T.StructField("retweet_count", T.LongType()),
            T.StructField("reply_count", T.LongType()),
        ])),
    ]))),
    T.StructField("includes", T.StructType([
        T.StructField("users", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("username", T.StringType()),
        ]))),
    ])),
])

ARTICLE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("company", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("source_type", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("valence", T.DoubleType()),
])

DEGREE = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("delta", T.DoubleType()),
])

LEMMA = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("lemma", T.StringType()),
])

TRAINING = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])
