"""Unions and reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.schemas import SCORE_CLASSES, require_columns

# Name prefixes stripped from score column names, in this order.
STRIP_PREFIXES = ("sentiment_", "vader_", "finbert_")


def union_sources(frames: dict[str, DataFrame], text_cols: Sequence[str] = ("text", "content"),
                  date_col: str = "date") -> DataFrame:
    """Union by name of sources with different columns.

    Each frame gets ``source_type`` (its key) first; missing columns are
    null; ``text`` becomes the first non-null of ``text_cols`` and
    ``date`` one DATE type.
    """
    parts = [df.withColumn("source_type", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    present = [c for c in text_cols if c in out.columns]
    if present:
        out = out.withColumn("text", F.coalesce(*[F.col(c) for c in present]))
    if date_col in out.columns and not isinstance(out.schema[date_col].dataType, T.DateType):
        out = out.withColumn(date_col, F.to_date(F.col(date_col).cast("string")))
    return out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """One table out of many (no loop-grown copies: a single plan)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def melt_scores(df: DataFrame, id_vars: Sequence[str], value_cols: Sequence[str],
                var_name: str = "score_type", value_name: str = "score",
                with_model: bool = True) -> DataFrame:
    """Score columns to rows ``(id_vars, score_type, score)``.

    ``score_type`` is the column name with the prefixes of
    ``STRIP_PREFIXES`` removed by literal replace, in that order; ``model``
    keeps the part before the class name, so two models' ``positive`` stay
    apart.
    """
    require_columns(df, [*id_vars, *value_cols])
    long = df.unpivot(list(id_vars), list(value_cols), "_name", value_name)
    t = F.col("_name")
    for p in STRIP_PREFIXES:
        t = F.replace(t, F.lit(p), F.lit(""))
    out = long.withColumn(var_name, t)
    if with_model:
        classes = "|".join(SCORE_CLASSES)
        out = out.withColumn("model", F.regexp_extract("_name", f"^(.*?)_?({classes})$", 1))
    return out.drop("_name")


def paste_scores(base: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """Put a scorer's columns next to the input rows (by key, not position)."""
    dup = [c for c in scores.columns if c in base.columns and c != id_col]
    if dup:
        raise ValueError(f"columns {dup} would repeat; score with another prefix")
    return base.join(scores, on=id_col, how="left")


def with_constants(df: DataFrame, values: dict) -> DataFrame:
    """Constant columns (source, company, run date)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def ensure_columns(df: DataFrame, cols: Sequence[str], default: str = "") -> DataFrame:
    """Add missing columns with a default (decided from the schema)."""
    missing = {c: F.lit(default) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df
