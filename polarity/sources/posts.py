"""Post search responses -> normalised posts.

Saved responses are read from a landing folder. The author of a post is
looked up in the ``includes.users`` list of the same response (first match
or null), inside the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.functions.text import date_or, utc_timestamp
from polarity.schemas import POST_RESPONSE

RETWEET_PREFIX = "RT @"


def read_post_responses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return (spark.read.schema(POST_RESPONSE).option("multiLine", multi_line)
            .json(path).withColumn("_file", F.col("_metadata.file_path")))


def explode_posts(responses: DataFrame) -> DataFrame:
    """Rows ``id, text, created_at, author_id, username, like_count,
    retweet_count, reply_count, lang, company``, with the response's file and
    the ``position`` in it; empty ``data`` gives none."""
    posts = (responses.select("_file", "company", F.col("includes.users").alias("_users"),
                              F.posexplode("data").alias("position", "p"))
             .select("_file", "company", "_users", (F.col("position") + 1).cast("int").alias("position"), "p.*"))
    same = F.filter("_users", lambda u: u["id"] == F.col("author_id"))
    return posts.select(
        "_file", "id", "text", "created_at", "author_id", F.get(same, F.lit(0))["username"].alias("username"),
        F.col("public_metrics.like_count").alias("like_count"),
        F.col("public_metrics.retweet_count").alias("retweet_count"),
        F.col("public_metrics.reply_count").alias("reply_count"),
        "lang", "company", "position")


def normalise_posts(df: DataFrame, source_name: str = "twitter") -> DataFrame:
    """``id, content, date, source, company, published_at``."""
    return df.select(
        F.col("id"), F.col("text").alias("content"), date_or("created_at").alias("date"),
        F.lit(source_name).alias("source"), F.col("company"),
        utc_timestamp("created_at").alias("published_at"))


def english_original(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """S7 (post rules): English and not a retweet."""
    return df.filter((F.col(lang_col) == "en") &
                     ~F.coalesce(F.col(text_col).startswith(RETWEET_PREFIX), F.lit(False)))


def posts(spark: SparkSession, path: str, per_company: int | None = None, days: int | None = None,
          as_of: str | None = None, days_cap: int | None = None, multi_line: bool = True) -> DataFrame:
    """S2 end to end: English originals, normalised.

    ``days`` keeps the look-back window of that many days before ``as_of``
    (which it needs), ``days_cap`` limits it (the recent-search API gives 7);
    ``per_company`` keeps the first rows of each company in the order of
    (response file, position, id). Both are off unless given.
    """
    from polarity.operators.sampling import first_k_per_group
    from polarity.sources.filters import lookback
    if days is not None and as_of is None:
        raise ValueError("days needs as_of, the day the window ends")
    rows = english_original(explode_posts(read_post_responses(spark, path, multi_line)))
    if days is not None:
        rows = lookback(rows.withColumn("_ts", utc_timestamp("created_at")), "_ts", as_of, days, days_cap).drop("_ts")
    return normalise_posts(first_k_per_group(rows, ["company"], ["_file", "position", "id"], per_company))
