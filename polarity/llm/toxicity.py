"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores
``sigmoid(bias + sum of the weights of its features)``, the features being its
words, their first 3 to 6 bytes and their last 3 and 4, hashed. Sentences are
combined by noisy-or, ``1 - prod(1 - p)``, and the weights are trained through
it from document labels alone. So the model also tells which sentences made a
document toxic.

Training reads at most ``SAMPLE`` labelled documents (the first by a hash of
their id): one distributed pass counts features by class, and every feature of
``SUPPORT`` documents whose association with the label is significant is kept
(the ``FEATURES`` strongest ones at least). Their occurrences by sentence are
checkpointed and stay on the executors; a gradient step sums one vector a task
over them, and the driver holds the weights only. Scoring is one pass without
a shuffle.

Null and empty texts have no sentences and score 0, as does everything if the
labels hold one class only. Null labels or ids are not trained on; rows of one
id count as toxic if any of them is. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.llm.scratch import lean, materialise
from polarity.llm.words import ALNUM, U, A, Words, mix, pieces

SAMPLE = 24_000      # labelled documents at most
HASH_BITS = 20
SUPPORT = 2          # documents that hold a feature, at least
SIGNIFICANT = 3.0    # standard errors between the classes' shares of documents that hold a feature
FEATURES = 4096      # the strongest ones, which are kept in any case
STEPS = 300
RATE = 0.1
PIECE = 1 << 17      # text bytes that are counted or scored at once
TASKS = 16           # of a gradient step, at most
DECAY = 0.1          # L2 weight, against the summed loss
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
_ENDS = np.zeros(256, dtype=np.int64)
_ENDS[[ord(c) for c in ".!?\n"]] = 1


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) of every feature of every word, and each sentence's first word."""
    ends = np.concatenate([[0], np.cumsum(_ENDS[words.buf])])[words.starts]
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    new = np.ones(len(words), dtype=bool)
    new[1:] = (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    codes = A.codes[words.buf]
    found, where = [], []
    for kind, (n, front) in enumerate([(None, True), *((n, True) for n in PREFIXES), *((n, False) for n in SUFFIXES)]):
        s, e = words.starts, words.ends
        if n:
            long = e - s > n
            s, e = s[long], e[long]
            s, e = (s, s + n) if front else (e - n, e)
        found.append((mix(A.of_runs(codes, s, e) + U(kind)) >> U(64 - HASH_BITS)).astype(np.int64))
        where.append(sentence[long] if n else sentence)
    return np.concatenate(found), np.concatenate(where), np.flatnonzero(new)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    for rows, buf, offsets in pieces(batches, "text", PIECE):
        words = Words(buf, offsets, ALNUM, lower=True)
        feature, sentence, first = _features(words)
        row = np.searchsorted(words.first, first, side="right") - 1
        pair = np.unique(row[sentence] << HASH_BITS | feature)
        label = rows.column("label").to_numpy()[pair >> HASH_BITS]
        for y in (0, 1):
            total[y] += np.bincount(pair[label == y] & (1 << HASH_BITS) - 1, minlength=1 << HASH_BITS)
    some = np.flatnonzero(total.sum(axis=0))
    for at in range(0, len(some), 100_000):
        i = some[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[0][i]), pa.array(total[1][i])], names=["feature", "clean", "toxic"])


def _occurrences(kept: np.ndarray):
    """Per run of documents: labels, sentences without a kept feature, and (document, features) of those with some, as bytes."""
    index = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    index[kept] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in pieces(batches, "text"):
            words = Words(buf, offsets, ALNUM, lower=True)
            feature, sentence, first = _features(words)
            which = index[feature]
            pair = np.unique(sentence[which >= 0] << HASH_BITS | which[which >= 0])
            found, s = np.unique(pair >> HASH_BITS, return_inverse=True)
            row = np.searchsorted(words.first, first, side="right") - 1
            of = row[found]
            plain = np.bincount(row, minlength=rows.num_rows) - np.bincount(of, minlength=rows.num_rows)
            columns = (rows.column("label").to_numpy(), plain, of, s, pair & (1 << HASH_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in columns], names=_OCCURRENCES)

    return run


_OCCURRENCES = ["label", "plain", "of", "sentence", "feature"]


def _gradient(shared):
    """One vector a task: the slope of the summed negative log likelihood by weight, the bias last."""

    def run(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        w = shared.value
        g, b = np.zeros_like(w), w[-1]
        for r in rows:
            label, plain, of, s, feature = (np.frombuffer(x, np.int32) for x in r)
            x = b + np.bincount(s, weights=w[feature], minlength=len(of))
            total = np.bincount(of, weights=np.logaddexp(0, x), minlength=len(plain)) + plain * np.logaddexp(0, b)
            slope = np.where(label == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
            each = slope[of] / (1 + np.exp(-x))
            g[:-1] += np.bincount(feature, weights=each[s], minlength=len(w) - 1)
            g[-1] += each.sum() + (slope * plain).sum() / (1 + np.exp(-b))
        yield g

    return run


@dataclass
class Model:
    """Weights by hashed feature and the bias of a sentence."""
    weights: np.ndarray
    bias: float


def _fit(found: DataFrame, n: int, size: int) -> tuple[np.ndarray, float]:
    """Adam on the mean negative log likelihood of the noisy-or of sentences."""
    context = found.sparkSession.sparkContext
    rows = found.coalesce(min(TASKS, max(context.defaultParallelism, 1))).rdd.map(tuple)  # planned once, for all steps
    w = np.zeros(size + 1)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        shared = context.broadcast(w)
        g = sum(rows.mapPartitions(_gradient(shared)).collect()) / max(n, 1)
        shared.destroy()
        g[:-1] += DECAY / max(n, 1) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs`` whose id passes ``usable`` (a condition on ``id``)."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    rows = rows.filter(usable) if usable is not None else rows
    chosen = rows.groupBy("id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows of 16 bytes
    texts = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text"))
    size = dict(texts.groupBy("label").count().collect())
    empty = Model(np.zeros(1 << HASH_BITS, dtype=np.float32), -np.inf)
    if len(size) < 2:
        return empty
    a, b = F.col("toxic") / size[1], F.col("clean") / size[0]
    p = (F.col("toxic") + F.col("clean") + 1) / (size[0] + size[1] + 2)
    counts = texts.mapInArrow(lean(_class_counts), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strength = F.abs(a - b) / F.sqrt(p * (1 - p) * (1 / size[0] + 1 / size[1]))
    ranked = materialise(counts.select("feature", strength.alias("strength"), (F.col("clean") + F.col("toxic")).alias("support")))
    most = max(FEATURES, ranked.filter((F.col("support") >= SUPPORT) & (F.col("strength") >= SIGNIFICANT)).count())
    order = [F.desc((F.col("support") >= SUPPORT) & (F.col("strength") >= SIGNIFICANT)), F.desc("strength"), "feature"]
    kept = ranked.orderBy(*order).limit(most).select("feature").toArrow().column(0).to_numpy()  # 8 MB at most
    found = materialise(texts.mapInArrow(lean(_occurrences(kept)), ", ".join(f"{c} binary" for c in _OCCURRENCES)))
    w, bias = _fit(found, size[0] + size[1], len(kept))
    empty.weights[kept] = w
    return Model(empty.weights, bias)


_SCORED = "score double, offending array<struct<start:int,length:int,score:double>>"


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = model.weights != 0
        for rows, buf, offsets in pieces(batches, "__text", PIECE):
            words = Words(buf, offsets, ALNUM, lower=True)
            feature, sentence, first = _features(words)
            hit = known[feature]
            pair = np.unique(sentence[hit] << HASH_BITS | feature[hit])
            x = model.bias + np.bincount(pair >> HASH_BITS, weights=model.weights[pair & (1 << HASH_BITS) - 1], minlength=len(first))
            of = np.searchsorted(words.first, first, side="right") - 1
            score = -np.expm1(-np.bincount(of, weights=np.logaddexp(0, x), minlength=rows.num_rows))
            offending = [[] for _ in range(rows.num_rows)]
            last = np.append(first[1:], len(words)) - 1
            for i in np.flatnonzero(x >= 0):
                r = of[i]
                start, end = words.starts[first[i]], words.ends[last[i]]
                lead = bytes(buf[offsets[r]:start]).decode()
                offending[r].append({"start": len(lead), "length": len(bytes(buf[start:end]).decode()), "score": float(1 / (1 + np.exp(-x[i])))})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(score), pa.array(offending, type=kind)], names=[*names, "score", "offending"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row (all if None; none may be called score
    or offending) with ``score`` and ``offending``: place (code points) and
    score of each sentence that scores 0.5 or more by itself."""
    carry = df.columns if carry is None else carry
    names = [f"c{i}" for i in range(len(carry))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col(text_col).alias("__text"))
    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry))
    done = rows.mapInArrow(lean(_score(df.sparkSession.sparkContext.broadcast(model), names)), kinds + _SCORED)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, carry)), "score", "offending")


def held_out(id_col: str = "doc_id") -> Column:
    """Fold 0 of 5 by a checksum of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
