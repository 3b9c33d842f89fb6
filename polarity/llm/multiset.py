"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs: its non-blank lines, each cut after
sentence ends, so that one-line texts have parts too. Every paragraph hashes
to a wide vector, and the fingerprint is the sum of these vectors:

* ``EXACT`` lanes hold 32-bit hashes, summed modulo 2**32. Equal multisets give
  equal sums in any order; a paragraph is inserted by adding its vector and
  deleted by subtracting it (:func:`combine`).
* ``SIGNS`` lanes hold +1 or -1 by a hash bit, summed modulo 2**20. They are a
  linear sketch: the cosine of two sums estimates the cosine of the two
  paragraph multisets, which gives the likeness (0 to 1).

Null, empty and blank texts have no paragraphs; their lanes are zero, they are
alike among themselves (1) and unlike all others (0).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarity.llm.scratch import text_bytes

EXACT = 8       # lanes, two for each of EXACT / 2 hashes
SIGNS = 128     # lanes, 64 for each of SIGNS / 64 hashes
EXACT_BITS = 32
SIGN_BITS = 20
CUT = r"\n+|(?<=[.!?])\s+"
BUCKET_BYTES = 8 << 20
FENCES = 128
NO_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CUT), lambda p: F.trim(p)), lambda p: p != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(p, F.lit(seed)))


def _half_sum(hashes: Column, by: int) -> Column:
    """Sum of one 32-bit half of each hash, modulo 2**32."""
    low = (1 << EXACT_BITS) - 1
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(x, by).bitwiseAND(low)).bitwiseAND(low))


def _plane(run: Column, bit: int) -> Column:
    """How many hashes of a run have this bit of each byte set, one count per byte of a long."""
    return F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, bit).bitwiseAND(0x0101010101010101))


def _sign_sums(hashes: Column) -> Column:
    """For each of 64 bits the sum of +1 or -1 by that bit of each hash, modulo
    2**SIGN_BITS. Eight bits are counted at a time, over runs of at most 127
    hashes, so that no count leaves its byte."""
    half = 1 << SIGN_BITS - 1
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / 127).cast("int"))), lambda i: F.slice(hashes, i * 127 + 1, F.lit(127)))
    planes = F.transform(runs, lambda run: F.array(*(_plane(run, bit) for bit in range(8))))

    def signed(counted: Column) -> Column:
        def one(j: Column) -> Column:  # bit j of a hash is bit j % 8 of byte j / 8
            ones = F.aggregate(counted, F.lit(0).cast("long"), lambda a, p: a + F.call_function(
                "shiftrightunsigned", F.get(p, j % 8), j - j % 8).bitwiseAND(255))
            return F.pmod(ones * 2 - n + half, F.lit(2 * half)) - half

        return F.transform(F.sequence(F.lit(0), F.lit(63)), one)

    return _once(planes, signed)


def lanes(parts: Column) -> Column:
    """Summed vectors of an array of paragraphs: EXACT sums, then SIGNS signed sums."""
    def exact(hashes: Column) -> Column:
        return F.array(_half_sum(hashes, 0), _half_sum(hashes, 32))

    def all_of(p: Column) -> Column:
        return F.concat(*(_once(_hashes(p, seed), exact) for seed in range(EXACT // 2)),
                        *(_once(_hashes(p, EXACT + k), _sign_sums) for k in range(SIGNS // 64)))

    return _once(parts, all_of)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union (sign 1) or of the difference (sign -1) of two multisets."""
    low, half = (1 << EXACT_BITS) - 1, 1 << SIGN_BITS - 1
    both = F.zip_with(a, b, lambda x, y: x + y * sign)
    return F.transform(both, lambda v, i: F.when(i < EXACT, v.bitwiseAND(low)).otherwise(F.pmod(v + half, F.lit(2 * half)) - half))


def as_text(v: Column) -> Column:
    """Lanes as one string of fixed-width hexadecimal numbers."""
    exact = F.transform(F.slice(v, 1, EXACT), lambda x: F.lpad(F.hex(x), EXACT_BITS // 4, "0"))
    signs = F.transform(F.slice(v, EXACT + 1, SIGNS), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << SIGN_BITS))), SIGN_BITS // 4, "0"))
    return F.lower(F.concat(F.array_join(exact, ""), F.array_join(signs, "")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal lanes."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(x, EXACT + 1, SIGNS), F.slice(y, EXACT + 1, SIGNS), lambda p, q: (p * q).cast("double")),
                           F.lit(0.0), lambda s, v: s + v)

    def of(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        cosine = _once(F.struct(dot(x, y).alias("xy"), F.sqrt(dot(x, x) * dot(y, y)).alias("size")), lambda d: F.when(
            d["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d["xy"] / d["size"]))).otherwise(0.0))
        return F.when(x == y, 1.0).otherwise(F.round(cosine, 6))

    return _once(F.struct(a.alias("a"), b.alias("b")), of)


def with_next(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, text, v) with those of the next row by (id, text) as ``next_text``
    and ``next_v``; the last row is followed by the first.

    Ids are dealt to ordered buckets of about BUCKET_BYTES: quantile fences cut
    any distribution of ids into equal parts, which are cut further by width.
    Rows of a bucket are put in order by one window; the last one gets the first
    row of the next bucket that has rows, from a table with a row per bucket.
    """
    buckets = max(1, -(-size // BUCKET_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(FENCES, buckets)
    finer = -(-buckets // parts)
    edges = df.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()
    if edges["low"] is None:
        edges = {"low": 0, "high": 0, "q": []}
    low = sorted({edges["low"], *(edges["q"] if parts > 1 else [])})
    width = [max(1, -(-(b - a) // finer)) for a, b in zip(low, [*low[1:], edges["high"] + 1])]
    fence = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in low)), lambda f: f <= F.col("id")))
    exact = lambda values: F.element_at(F.array(*(F.lit(Decimal(x)).cast("decimal(20,0)") for x in values)), F.col("fence"))
    inside = F.floor((F.col("id").cast("decimal(20,0)") - exact(low)) / exact(width)).cast("long")
    dealt = df.withColumn("fence", fence).withColumn("bucket", F.col("fence") * (finer + 1) + F.least(inside, F.lit(finer))).drop("fence")

    first = dealt.groupBy("bucket").agg(F.min(F.struct("id", "text")).alias("head"))
    order = Window.orderBy("bucket")
    after = dealt.select("bucket").distinct().select(
        "bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("follows"))
    heads = after.join(first.withColumnRenamed("bucket", "follows"), "follows").select("bucket", F.col("head.text").alias("head_text"))
    w = Window.partitionBy("bucket").orderBy("id", "text")
    led = dealt.withColumn("v", lanes(paragraphs(F.col("text")))).withColumns(
        {"next_text": F.lead("text").over(w), "next_v": F.lead("v").over(w), "inner": F.lead(F.lit(True)).over(w)})
    return led.join(heads, "bucket", "left").select(
        "id", "text", "v", F.when(F.col("inner"), F.col("next_text")).otherwise(F.col("head_text")).alias("next_text"),
        F.when(F.col("inner"), F.col("next_v")).otherwise(lanes(paragraphs(F.col("head_text")))).alias("next_v"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited form (the last half of its
    code points replaced by the first as many of the next text by ascending
    id), and the likeness to the edited and to the next text. Null texts count
    as empty, a null id comes first and stays null; rows of one id follow each
    other by their text."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(rows, text_bytes(df, text_col))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    led = led.withColumn("edited", edited).withColumn("w", lanes(paragraphs(F.col("edited"))))
    return led.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                      as_text(F.col("v")).alias("fingerprint"), as_text(F.col("w")).alias("edited_fingerprint"),
                      likeness(F.col("v"), F.col("w")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
