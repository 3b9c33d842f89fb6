"""Corpus pipeline: documents in, packed training bins out.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs,
sf_dir), works on all rows its predecessor kept and returns a DataFrame; all
but the last return the columns of ``docs``. ``run`` writes the result of each
stage as Parquet in the shared folder and reads it as the next one's input. The
first result gets a number for each row, ``ROW``, by which the next stages tell
rows apart, whatever their ids; a stage that is given rows without it numbers
them itself.

Nulls, empty texts, repeated rows, empty tables and further columns of any name
are handled as the operators state; a stage never looks at columns beside
doc_id, text, source and (to update it) n_chars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.llm import toxicity
from polarity.llm.decontaminate import contamination
from polarity.llm.ngram_join import linked_groups
from polarity.llm.packing import pack, word_count
from polarity.llm.repeats import remove_repeats
from polarity.llm.scratch import materialise, numbered, remove, scratch_scope, shared_dir, table


ROW = "__pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``, which is stable as it is read from files."""
    return docs if ROW in docs.columns else numbered(docs, ROW)


def _plain(docs: DataFrame) -> DataFrame:
    """Columns under names that no operator uses; the position tells them apart."""
    return docs.toDF(*(f"d{i}" for i in range(len(docs.columns))))


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def _at(docs: DataFrame, column: str) -> str:
    return f"d{docs.columns.index(column)}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    with scratch_scope(spark):
        model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out("id"))
    scored = toxicity.score(_plain(docs), model, text_col=_at(docs, "text"))
    return scored.filter("score < 0.5").drop("score", "offending").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id, of these the one with the smallest text; null ids come last."""
    every = _numbered(docs)
    rows, number, key, text = _plain(every), _at(every, ROW), _at(every, "doc_id"), _at(every, "text")
    with scratch_scope(spark) as keep:
        groups = materialise(linked_groups(every.select(F.col(ROW).alias("doc_id"), "text")))
        several = groups.filter("doc_id != component_id").select("component_id").distinct()
        members = groups.join(several, "component_id", "left_semi").select(F.col("doc_id").alias("member"), "component_id")
        order = F.struct(F.col(key).isNull(), F.col(key), F.col(text), F.col("member"))
        first = members.join(rows.select(number, key, text), F.col("member") == F.col(number)).groupBy("component_id").agg(F.min_by("member", order).alias("first"))
        copies = keep(materialise(members.join(first, "component_id").filter("member != first").select(F.col("member").alias("copy"))))
    return rows.join(copies, rows[number] == F.col("copy"), "left_anti").toDF(*every.columns).select(*_names(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur again; other texts stay as they are,
    and documents of which nothing is left go."""
    text = _at(docs, "text")
    done = remove_repeats(_plain(docs), text, text, carry=list(_plain(docs).columns))
    done = done.filter("n_removed = 0 OR n_removed < n_words").withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = _at(docs, "n_chars")
        done = done.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return done.drop("n_words", "n_removed", "kept").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    every = _numbered(docs)
    with scratch_scope(spark) as keep:
        found = contamination(every.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        hit = keep(materialise(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("hit"))))
    rows = _plain(every)
    return rows.join(hit, rows[_at(every, ROW)] == F.col("hit"), "left_anti").toDF(*every.columns).select(*_names(docs))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the training bins, counted in words."""
    return pack(docs.select("doc_id", "source", word_count("text").alias("n_tokens"), F.xxhash64("text").alias("cluster")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_bins),
]

#: A classifier trained here decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents").drop(ROW)
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done = done if k else done.withColumn(ROW, F.monotonically_increasing_id())
        done.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
