"""Filters and rankings over scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.schemas import SCORE_CLASSES, require_columns


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` equals ``value`` (label, source type, ...)."""
    require_columns(df, [col])
    return df.filter(F.col(col) == F.lit(value))


def disagree(label_a: str, label_b: str) -> Column:
    """Labels differ; a null on either side counts as a difference."""
    return F.coalesce(F.col(label_a) != F.col(label_b), F.lit(True))


def disagreements(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """P5: rows where two models' labels differ (null vs anything differs)."""
    require_columns(df, [label_a, label_b])
    return df.filter(disagree(label_a, label_b))


def _prefix(label_col: str) -> str:
    return label_col[: -len("label")] if label_col.endswith("label") else label_col


def severity(df: DataFrame, label_a: str, label_b: str) -> Column | None:
    """Sum over the classes of |score_a - score_b|; pairs with a missing
    column are skipped; None when model a has no positive column."""
    pa, pb = _prefix(label_a), _prefix(label_b)
    if f"{pa}positive" not in df.columns:
        return None
    terms = [F.abs(F.col(f"{pa}{c}") - F.col(f"{pb}{c}")) for c in SCORE_CLASSES
             if f"{pa}{c}" in df.columns and f"{pb}{c}" in df.columns]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def top_disagreements(df: DataFrame, label_a: str, label_b: str, id_col: str,
                      k: int | None = None) -> DataFrame:
    """L2: disagreements with a severity, largest first (id breaks ties);
    ``k`` keeps the top k (a bounded top-k, no global sort)."""
    out = disagreements(df, label_a, label_b)
    sev = severity(df, label_a, label_b)
    if sev is None:
        out = out.orderBy(id_col)
    else:
        # rounded, so that severities equal up to the last bit rank by id
        out = out.withColumn("disagreement_score", F.round(sev, 9)).orderBy(F.desc("disagreement_score"), id_col)
    return out.limit(k) if k is not None else out


def clear_cases(df: DataFrame, expected_col: str,
                classes: Sequence[str] = ("positive", "negative")) -> DataFrame:
    """Rows whose expected label is one of the clear classes."""
    require_columns(df, [expected_col])
    return df.filter(F.col(expected_col).isin(list(classes)))
