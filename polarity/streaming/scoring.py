"""Incremental scoring of a growing landing folder.

Collection in the reference is a poll; here new files landed in a folder
are picked up by Structured Streaming and every micro-batch goes through
the same batch operators (process text, score). Each batch is written to
its own ``batch_id`` partition with dynamic overwrite, so a batch that is
run again after a failure replaces its own output: the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from polarity.functions.text import preprocess
from polarity.operators.scoring import Scorer, create_scorer


def score_batch(batch: DataFrame, text_col: str, id_col: str, scorer: Scorer,
                do_preprocess: bool = True) -> DataFrame:
    col = text_col
    if do_preprocess:
        batch = batch.withColumn("processed_text", preprocess(text_col))
        col = "processed_text"
    return scorer.score(batch, col, id_col)


def score_stream(spark: SparkSession, source_path: str, schema: T.StructType, sink_path: str,
                 text_col: str = "text", id_col: str = "id", model: str | Scorer | None = None,
                 fmt: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None, *, checkpoint: str) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there
    and stops. ``checkpoint`` is a folder of this stream alone, in a store that
    outlives the session: a stream started again with another one would count
    its batches from 0 and replace the output of earlier ones."""
    scorer = model if isinstance(model, Scorer) else create_scorer(model)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(batch, text_col, id_col, scorer).withColumn("batch_id", F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    writer = (stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
