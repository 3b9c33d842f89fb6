"""Article search responses -> normalised articles.

The HTTP call is not part of the library: saved responses (one JSON
document per file, with a ``company`` field added by the lander) are read
from a landing folder with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.text import compose_text, date_or, url_domain, utc_timestamp
from polarity.operators.reshape import ensure_columns
from polarity.operators.sampling import first_k_per_group
from polarity.schemas import ARTICLE_RESPONSE, require_columns
from polarity.sources.filters import lookback

EXPECTED = ("url", "domain", "title", "text", "date")


def read_article_responses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw responses, schema not inferred: a JSON document per file, or one per
    line with ``multi_line=False`` (such files are split over tasks)."""
    return (spark.read.schema(ARTICLE_RESPONSE).option("multiLine", multi_line)
            .json(path).withColumn("_file", F.col("_metadata.file_path")))


def split_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a status other than 'ok' is rejected."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return raw.filter(ok), raw.filter(~ok)


def explode_articles(responses: DataFrame) -> DataFrame:
    """One row per article with its response's file and its 1-based ``position`` there."""
    return (responses.select("_file", "company", F.posexplode("articles").alias("_pos", "a"))
            .select("_file", "company", (F.col("_pos") + 1).cast("int").alias("position"), "a.*"))


def normalise_articles(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """T2-T4 + P2: ``text = title + '. ' + description``, ``domain`` from
    the url, ``date`` from ``publishedAt`` (the run date when the column is
    absent), missing expected columns as ''. ``source_type = 'news'``."""
    out = df
    if "source" in out.columns and isinstance(out.schema["source"].dataType, T.StructType):
        # the API's nested source becomes its name (posts carry a plain string)
        out = out.withColumn("source", F.col("source.name"))
    if "title" in out.columns and "description" in out.columns:
        out = out.withColumn("text", compose_text("title", "description"))
    if "url" in out.columns:
        out = out.withColumn("domain", url_domain("url"))
    if "publishedAt" in out.columns:
        out = out.withColumn("date", date_or("publishedAt"))
    elif as_of is not None:
        out = out.withColumn("date", F.lit(as_of).cast("date"))
    out = ensure_columns(out, EXPECTED, "")
    return out.withColumn("source_type", F.lit("news"))


def articles(spark: SparkSession, path: str, per_company: int | None = None, days: int | None = None,
             as_of: str | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 end to end: (articles, rejected responses).

    ``days`` keeps articles published in that many days before ``as_of``
    (which it needs); ``per_company`` the first articles of each company in
    the order of (response file, position, url) (L1). Both are off unless given.
    """
    if days is not None and as_of is None:
        raise ValueError("days needs as_of, the day the window ends")
    ok, bad = split_responses(read_article_responses(spark, path, multi_line))
    arts = explode_articles(ok)
    if days is not None:
        arts = lookback(arts.withColumn("_ts", utc_timestamp("publishedAt")), "_ts", as_of, days).drop("_ts")
    arts = first_k_per_group(arts, ["company"], ["_file", "position", "url"], per_company)
    return normalise_articles(arts.drop("_file"), as_of), bad


def url_list(df: DataFrame, k: int | None = None, group_cols=("company",), order_col: str = "position") -> DataFrame:
    """Rows with a non-empty url; the first ``k`` per group if given."""
    require_columns(df, ["url", order_col, *group_cols])
    kept = df.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    return first_k_per_group(kept, list(group_cols), [order_col], k)
