"""Registered queries of this package: each applies one operator, with the
parameters meant for production, to its whole table, and derives the digest
columns from what the operator returns. ``ORACLE`` holds DuckDB SQL where SQL
expresses the query on whole tables; the others are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.llm import token_files, toxicity, warc
from polarity.llm.collocations import collocations
from polarity.llm.decontaminate import contamination, covered
from polarity.llm.html_text import main_text
from polarity.llm.licences import scan_licences
from polarity.llm.minhash_tables import near_duplicates
from polarity.llm.multiset import edited_fingerprints
from polarity.llm.ngram_join import linked_groups
from polarity.llm.oracle import ORACLE  # noqa: F401
from polarity.llm.packing import pack, word_count
from polarity.llm.prefix_trie import mixed_turns, ordered_turns, prefix_trie
from polarity.llm.repeats import remove_repeats
from polarity.llm.scratch import materialise, remove, scratch_scope, shared_dir, table

QUERIES: dict = {}
END_ID = 2


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_warc(spark, path, payloads=False), hops=2)  # as write_warc links them
    fields = F.col("metadata.fields")
    done = materialise(captures.select(
        F.try_element_at(fields, F.lit("key")).cast("long").alias("page_id"), fields["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.try_element_at(fields, F.lit("refers-to-key")).cast("long").alias("refers_to")))
    remove(spark, path)
    return done


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # a package of this machine, which only this query needs
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4()}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    done = materialise(token_files.read_tokens(spark, path, with_ids=False))
    remove(spark, path)
    return token_files.with_starts(done).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query
def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out("id"))
    done = toxicity.score(docs, model, carry=["doc_id"])
    return done.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       F.size("offending").alias("n_offending"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", "source", word_count("text").alias("n_tokens"), F.xxhash64("text").alias("cluster")))


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = covered("spans")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op11_minhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    with scratch_scope(spark) as keep:
        turns = materialise(ordered_turns(table(spark, sf_dir, "conversations")))
        return keep(prefix_trie(mixed_turns(turns, conv - conv % 100, heads, 5)))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
