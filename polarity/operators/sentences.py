"""T7 on raw text: words by rule and sentences without a trained model.

Words: double quotes become opening and closing marks, contractions are cut
before their ending (``do n't``, ``it 's``), and one pattern takes numbers with
their separators, runs of letters with inner hyphens, points of omission, and
every other sign by itself.

Sentences: a word that ends with . ! or ? (and closing signs) may end one.
Whether a point belongs to an abbreviation is learned from the texts: one
aggregation counts how often each word stands with a point and without. A word
of up to ``LONGEST`` characters that has a point at least ``OFTEN`` times and in
nearly all places (``SHARE`` percent) is an abbreviation. A candidate ends a
sentence unless it is an abbreviation or a single letter, or the next word begins
with a small letter. Null and empty texts have no words and no sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.perfect_hash import PerfectHash
from polarity.functions.word_runs import hashes_of, slabs
from polarity.schemas import require_columns

LONGEST = 5
OFTEN = 5
SHARE = 90
PART_ABBREVIATIONS = 8_000_000  # 70 MB of arrays

# Endings that a contraction is cut before, and the pattern of a word.
ENDINGS = "'(s|m|d|ll|re|ve)"
WORD = r"``|''|n't|'(?:s|m|d|ll|re|ve)|\.\.\.+|[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^ \t\n\r\f\x0B\p{L}\p{N}]"
BLANKS = r"[ \t\n\r\f\x0B]+"


def raw_words(c: str | Column) -> Column:
    """Words and signs of uncleaned text, in order."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    t = F.regexp_replace(t, r'(^|[ \t\n\r(\[{<])"', "$1`` ")
    t = F.regexp_replace(t, '"', " '' ")
    t = F.regexp_replace(t, r"(?i)([a-z])(n't)\b", "$1 $2")
    t = F.regexp_replace(t, r"(?i)([a-z])" + ENDINGS + r"\b", "$1 '$2")
    return F.regexp_extract_all(t, F.lit("(?i)" + WORD), F.lit(0))


def abbreviations(df: DataFrame, text_col: str, longest: int = LONGEST, often: int = OFTEN, share: int = SHARE) -> DataFrame:
    """(token): words without their point that mostly stand with one."""
    words = df.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANKS)).alias("w"))
    word = F.lower(F.regexp_extract("w", r"([\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*)\.?[,;:)\]'\"]*$", 1))
    found = words.select(word.alias("token"), F.col("w").rlike(r"[\p{L}\p{N}]\.[,;:)\]'\"]*$").alias("point")).filter(f"token != '' AND length(token) <= {int(longest)}")
    counts = found.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("point").cast("long")).alias("k"))
    return counts.filter(f"k >= {int(often)} AND 100 * k >= {int(share)} * n").select("token")


class _Known:
    """A set of words by hash, 9 bytes each."""

    def __init__(self, words: list[str]):
        keys = np.unique(hashes_of(words))
        self.hash, self.keys = PerfectHash.build(keys), np.empty_like(keys)
        self.keys[self.hash.find(keys)] = keys

    def holds(self, words: list[str]) -> np.ndarray:
        if not len(self.keys) or not words:
            return np.zeros(len(words), bool)
        hashes = hashes_of(words)
        at = self.hash.find(hashes)
        return (at >= 0) & (self.keys[at] == hashes)


def _base(word: str) -> str:
    """The word before its point, in lower case, without what is left of its last letters and digits' run."""
    at = len(word)
    while at and (word[at - 1].isalnum() or (word[at - 1] == "." and at > 1 and word[at - 2].isalnum() and at < len(word))):
        at -= 1
    return word[at:].lower()


_CLOSING = "\"')]}"


def _split(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in slabs(batches, "_text"):
            texts = [[w for w in re.split(BLANKS, t or "") if w] for t in rows.column("_text").to_pylist()]
            places, bases = [], []
            for r, words in enumerate(texts):
                for i in range(len(words) - 1):
                    w = words[i].rstrip(_CLOSING)
                    if w[-1:] in (".", "!", "?") and unicodedata.category(words[i + 1][0]) != "Ll":
                        places.append((r, i))
                        bases.append(_base(w[:-1]) if w[-1] == "." and w[-2:-1] != "." else "")
            held = known.holds(bases)
            cuts: list[list[int]] = [[0] for _ in texts]
            for (r, i), base, abbreviation in zip(places, bases, held.tolist()):
                if not abbreviation and not (len(base) == 1 and base.isalpha()):
                    cuts[r].append(i + 1)
            out = [[" ".join(words[a:b]) for a, b in zip(cut, [*cut[1:], len(words)])] if words else [] for words, cut in zip(texts, cuts)]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(out, pa.list_(pa.string()))], names=[*names, "_sentences"])

    return run


def with_sentences(df: DataFrame, text_col: str, out_col: str = "sentences", known: DataFrame | None = None) -> DataFrame:
    """``df`` with the sentences of each text, their words joined by one space.
    ``known`` are abbreviations (token); by default those of the texts themselves."""
    require_columns(df, [text_col])
    known = abbreviations(df, text_col) if known is None else known
    # an abbreviation is short and frequent; more than these are an error of the thresholds, not a case to cut off
    n = known.count()
    if n > PART_ABBREVIATIONS:
        raise ValueError(f"{n} abbreviations: raise often or share")
    shared = df.sparkSession.sparkContext.broadcast(_Known(known.toArrow().column("token").to_pylist()))
    carried = [c for c in df.columns if c != out_col]
    names = [f"c{i}" for i in range(len(carried))]
    rows = df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(m) for c, m in zip(carried, names)), F.col(text_col).alias("_text"))
    kind = T.StructType([*(T.StructField(m, df.schema[c].dataType) for c, m in zip(carried, names)), T.StructField("_sentences", T.ArrayType(T.StringType()))])
    done = rows.mapInArrow(_split(shared, names), kind)
    return done.select(*(F.col(m).alias(c) for m, c in zip(names, carried)), F.col("_sentences").alias(out_col))
