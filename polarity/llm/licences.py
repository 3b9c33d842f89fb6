"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, no copyright notices, one
spelling of equivalent words, no punctuation, single blanks. Its SHA-256 is
joined with the digests of known licences in the same form. Whole texts are
looked up, and so is each of their lines, as a notice often stands alone.

Only digests and ids are joined; texts stay where they are read. The list of
known licences is a resource of the library (or the caller's, whose size is
checked before it is broadcast). Parts without any of the few words of which
every known text holds one are passed over before they are normalised.

Null and empty texts match nothing. Rows of one id and text have equal results,
once for each row. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.llm.licence_texts import LICENCES

#: Words of equal meaning in licence texts, and the form kept.
SAME_WORDS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licence": "sublicense",
    "acknowledgement": "acknowledgment", "favour": "favor", "honour": "honor", "organisation": "organization", "modelling": "modeling",
    "fulfil": "fulfill", "noncommercial": "non commercial", "non infringement": "noninfringement", "per cent": "percent",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "https": "http", "v": "version",
}
#: A notice begins a line and ends with its sentence or the line: copyright followed by (c), a year, a place for one, or "by".
_COPYRIGHT = (r"(?im)^[\s#*/;\-]*(?:copyright[\s,:]*(?:\(c\)|©|\d{4}|by\b|[\[<{])|\(c\)\s*(?:copyright\b|\d{4}|by\b|[\[<{])|©|all rights reserved\b)"
              r"[^\n]*?(?:(?<=\p{L}{4})\.(?=[ \t]+\p{L})(?:[ \t]*all rights reserved\b\.?)?|$)")
MOST_KNOWN = 20_000  # known texts that are broadcast; more are shuffled


def canonical(text: Column) -> Column:
    """Canonical form; empty if nothing is left."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), _COPYRIGHT, " ")
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for word, kept in SAME_WORDS.items():
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {kept} "))
    return F.trim(F.regexp_replace(c, r" version (?=\d)| +", " "))


def known_licences(spark: SparkSession, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, canonical); of several ids with one digest the smallest."""
    rows = spark.createDataFrame(LICENCES if licences is None else licences, "license_id string, text string")
    forms = rows.select("license_id", canonical(F.col("text")).alias("canonical")).filter("canonical != ''")
    return forms.groupBy("canonical").agg(F.min("license_id").alias("license_id")).select(F.sha2("canonical", 256).alias("digest"), "license_id", "canonical")


def anchors(forms: list[str]) -> list[str]:
    """Few words of which every canonical form holds one. Each stands in any
    text of that form as it is, as equivalent spellings are not chosen."""
    spelled = {w for pair in SAME_WORDS.items() for w in " ".join(pair).split()}
    left = [{w for w in f.split() if w.isascii() and w.isalnum() and w not in spelled} for f in forms]
    left = [{w for w in f if len(w) > 4} or f for f in left]  # short words are in any text
    if not all(left):
        return []
    chosen = []
    while left:
        words = sorted(set().union(*left))
        best = max(words, key=lambda w: (sum(w in f for f in left), len(w)))
        chosen.append(best)
        left = [f for f in left if best not in f]
    return chosen


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df``: its id, ``license_id`` (whose text it is, else
    null), ``n_license_lines`` and ``line_licenses`` (sorted ids of its lines)."""
    known = known_licences(df.sparkSession) if known is None else known
    forms = [r[0] for r in known.select("canonical").limit(MOST_KNOWN + 1).collect()]
    few = len(forms) <= MOST_KNOWN
    known = known.select("digest", "license_id")
    known = F.broadcast(known) if few else known
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("part")))
    parts = rows.select("id", "key", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("part"))), lines)).alias("p"))
    words = anchors(forms) if few else []
    if words:  # a cheap test that every match passes
        parts = parts.filter(F.lower("p.part").rlike("|".join(words)))
    digests = parts.select("id", "key", F.col("p.line").alias("line"), canonical(F.col("p.part")).alias("c")).filter("c != ''")
    hits = digests.select("id", "key", "line", F.sha2("c", 256).alias("digest")).join(known, "digest")
    found = hits.dropDuplicates(["id", "key", "line"]).groupBy("id", "key").agg(
        F.max(F.when(F.col("line") == 0, F.col("license_id"))).alias("license_id"), F.count(F.when(F.col("line") > 0, 1)).alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("license_id")))).alias("line_licenses"))
    left, right = rows.select("id", "key").alias("l"), found.alias("r")
    both = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.key") == F.col("r.key")), "left")
    return both.select(F.col("l.id").alias(id_col), "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
                       F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
