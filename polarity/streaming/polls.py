"""Overlapping polls (S1, S2, S8): rows that an earlier poll brought are dropped.

A poll asks for the last days again, so most of its rows were there before. Each
poll is a batch with a number; its accepted rows, its rejects and what it adds to
the state (key and time of accepted rows) are written under that number, so a
poll that is run again after a lost driver replaces itself and sees the same
earlier polls. The watermark is the latest time of the earlier polls less
``delay_days``: rows before it are rejected as late, and only state from it on is
read, so the state that is joined stays as large as the window, not the history.
Of several rows of a key in one poll the earliest stays. Rows without a key or a
time are rejected.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.schemas import require_columns

LATE, NO_KEY = "late", "no key or time"


def _earlier(df: DataFrame, folder: str, batch_id: int) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(f"{folder}/seen").filter(F.col("poll") < batch_id)
    except AnalysisException:  # the first poll
        return None


def take_poll(df: DataFrame, folder: str, batch_id: int, key_col: str, time_col: str, delay_days: int) -> None:
    """Write the new rows of a poll to ``folder``/rows and others that aren't repeats to ``folder``/rejects."""
    require_columns(df, [key_col, time_col])
    spark, columns = df.sparkSession, df.columns
    key, time = F.col(key_col), F.col(time_col).cast("timestamp")
    earlier = _earlier(df, folder, batch_id)
    # two literals, so that the day filter reaches the files of the state
    mark = None if earlier is None else earlier.agg(F.max("time") - F.expr(f"INTERVAL {int(delay_days)} DAYS")).first()[0]
    late = F.lit(False) if mark is None else time < F.lit(mark)
    reason = F.when(key.isNull() | time.isNull(), NO_KEY).when(late, LATE)
    marked = df.withColumn("reason", reason)
    marked.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/rejects/poll={int(batch_id)}")
    rows = marked.filter("reason IS NULL").select(key.alias("_key"), time.alias("_time"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    rows = rows.groupBy("_key").agg(F.min_by(F.struct("_time", "_row"), F.struct("_time", F.xxhash64("_row"))).alias("r")).select("_key", "r.*")
    if mark is not None:
        seen = earlier.filter((F.col("day") >= F.lit(mark).cast("date")) & (F.col("time") >= F.lit(mark))).select(F.col("key").alias("_key")).distinct()
        rows = rows.join(seen, "_key", "left_anti")
    rows.select("_row.*").write.mode("overwrite").parquet(f"{folder}/rows/poll={int(batch_id)}")
    new = spark.read.parquet(f"{folder}/rows/poll={int(batch_id)}")
    state = new.select(key.alias("key"), time.alias("time"), time.cast("date").alias("day"))
    state.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/seen/poll={int(batch_id)}")


def collected(df: DataFrame, folder: str, kind: str = "rows") -> DataFrame:
    """What all polls so far have brought (``rows``) or rejected (``rejects``), with their poll; ``df`` gives the session."""
    return df.sparkSession.read.parquet(f"{folder}/{kind}")


def collect_polls(stream: DataFrame, folder: str, checkpoint: str, key_col: str, time_col: str, delay_days: int):
    """Run ``take_poll`` on each micro-batch of a stream of landed files; returns the writer's query."""
    take = lambda df, batch: take_poll(df, folder, batch, key_col, time_col, delay_days)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
