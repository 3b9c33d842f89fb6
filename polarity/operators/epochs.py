"""Training a text classifier by epochs (M6), with saving and loading (M7).

The texts' features are made once: hashed counts of the cleaned text's words,
damped by a logarithm and scaled to length one, packed into blocks of rows and
written to ``folder``, one partition a mini-batch. A row's mini-batch follows
from a hash of its id, so batches are the same in every run. Each step reads
the blocks of one batch, sums the gradient of the soft-max loss over executors
(``treeAggregate``; one vector of the model's size reaches the driver) and
updates the weights on the driver (Adam with decoupled weight decay). An epoch
takes all batches in an order drawn from the seed and the epoch.

After an epoch the weighted F1 (A7) on the validation part is computed; training
ends after ``epochs`` or when ``patience`` epochs brought no better value, and the
best epoch's weights are the model. The state after each epoch is written to
``folder``: a run that is given the folder of one that was lost goes on after the
last whole epoch, with the same result.

Rows without a label or an id are left out. Null and empty texts have no
features. Rows of one id are in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.functions.word_runs import code_points, not_blank, slabs, word_bounds, word_hashes
from polarity.operators.analytics import classification_metrics
from polarity.operators.sampling import stratified_split
from polarity.operators.scoring import Scorer, register_scorer
from polarity.operators.training import with_clean_text
from polarity.schemas import SCORE_CLASSES, require_columns

BATCH_ROWS = 16_384
BLOCK_ROWS = 2048


def text_features(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges of the rows, feature, value) of cleaned texts."""
    points, at = code_points(texts)
    start, end, row = word_bounds(points, at, not_blank())
    name = (word_hashes(points, start, end) % np.uint64(size)).astype(np.int64)
    pair, count = np.unique(row * size + name, return_counts=True)
    value = 1 + np.log(count)
    edges = np.searchsorted(pair // size, np.arange(len(texts) + 1))
    norm = np.sqrt(np.add.reduceat(np.append(value ** 2, 0), np.minimum(edges[:-1], len(value))))
    return edges, pair % size, value / np.repeat(norm, np.diff(edges))


_BLOCK = "batch int, labels binary, edges binary, features binary, values binary"


def _pack(size: int):
    """Runs of rows of one batch as a block each; rows come in order of their batch."""
    def block(batch, rows):
        labels, edges, features, values = [], [0], [], []
        for part in rows:
            e, f, v = text_features(part.column("_clean"), size)
            labels.append(part.column("_label").to_numpy().astype(np.int32))
            edges.extend((e[1:] + edges[-1]).tolist())
            features.append(f.astype(np.int32))
            values.append(v)
        columns = (np.concatenate(labels), np.array(edges, np.int64), np.concatenate(features), np.concatenate(values))
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["batch", "labels", "edges", "features", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, batch, n = [], None, 0
        for rows in slabs(batches, "_clean", 4 << 20):
            number = rows.column("_batch").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), rows.num_rows]
            for a, b in zip(cut[:-1], cut[1:]):
                if held and (batch != number[a] or n + b - a > BLOCK_ROWS):
                    yield block(batch, held)
                    held, n = [], 0
                batch = int(number[a])
                held.append(rows.slice(a, b - a))
                n += b - a
        if held:
            yield block(batch, held)

    return run


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = (np.int32, np.int64, np.int32, np.float64)
    return tuple(np.frombuffer(row[c], k) for c, k in zip(("labels", "edges", "features", "values"), kinds))


def probabilities(weights: np.ndarray, edges: np.ndarray, features: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(row, class) soft-max; the last column of the weights is the bias."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    logits = np.stack([np.bincount(row, weights=w[features] * values, minlength=len(edges) - 1) for w in weights], axis=1) + weights[:, -1]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(weights: np.ndarray, labels: np.ndarray, edges: np.ndarray, features: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
    """(summed gradient of the loss, rows) of a block."""
    slope = probabilities(weights, edges, features, values)
    slope[np.arange(len(labels)), labels] -= 1
    row = np.repeat(np.arange(len(labels)), np.diff(edges))
    g = np.empty_like(weights)
    for c in range(len(weights)):
        g[c, :-1] = np.bincount(features, weights=slope[row, c] * values, minlength=weights.shape[1] - 1)
        g[c, -1] = slope[:, c].sum()
    return g, len(labels)


@dataclass
class Adam:
    """Weights and what the next update needs."""
    weights: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    @classmethod
    def zero(cls, classes: int, size: int) -> Adam:
        return cls(*(np.zeros((classes, size + 1)) for _ in range(3)))

    def update(self, g: np.ndarray, rate: float, decay: float) -> None:
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        move = (self.m / (1 - 0.9 ** self.step)) / (np.sqrt(self.v / (1 - 0.999 ** self.step)) + 1e-8)
        kept = self.weights.copy()
        kept[:, -1] = 0  # the bias doesn't decay
        self.weights = self.weights - rate * (move + decay * kept)


def batch_order(batches: int, seed: int, epoch: int) -> list[int]:
    return np.random.default_rng([seed, epoch]).permutation(batches).tolist()


@dataclass
class EpochModel:
    """A trained classifier: soft-max over hashed words. ``labels`` are the class names by
    number; ``max_tokens`` is what training and prediction read of a text (None: all)."""
    weights: np.ndarray
    labels: list[str]
    max_tokens: int | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        row = (bytearray(self.weights.tobytes()), self.labels, self.max_tokens)
        spark.createDataFrame([row], "weights binary, labels array<string>, max_tokens int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EpochModel:
        r = spark.read.parquet(path).first()
        return cls(np.frombuffer(r["weights"]).reshape(len(r["labels"]), -1), list(r["labels"]), r["max_tokens"])

    def predict(self, df: DataFrame, text_col: str, prefix: str = "sentiment_") -> DataFrame:
        """``df`` with a probability for each score class (null for one that the model doesn't know) and the label."""
        size, weights = self.weights.shape[1] - 1, df.sparkSession.sparkContext.broadcast(self.weights)
        names = [f"c{i}" for i in range(len(df.columns))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in slabs(batches, "_clean"):
                p = probabilities(weights.value, *text_features(rows.column("_clean"), size))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), lists], names=[*names, "_p"])

        rows = with_clean_text(df, text_col, self.max_tokens).toDF(*names, "_clean")
        kind = rows.drop("_clean").schema.add("_p", T.ArrayType(T.DoubleType()))
        scored = rows.mapInArrow(run, kind)
        place = {c: i for i, c in enumerate(self.labels)}
        scores = [(F.col("_p")[place[c]] if c in place else F.lit(None).cast("double")).alias(f"{prefix}{c}") for c in SCORE_CLASSES]
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        label = F.element_at(F.array(*map(F.lit, self.labels)), best).alias(f"{prefix}label")
        return scored.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns)), *scores, label)


@dataclass
class EpochResult:
    model: EpochModel
    metrics: list[dict]  # one per epoch: epoch, accuracy, precision, recall, f1
    best: int            # the epoch whose weights the model has
    split: DataFrame


_STATE = "epoch int, step long, weights binary, m binary, v binary, accuracy double, precision double, recall double, f1 double"


def _states(spark: SparkSession, folder: str) -> list:
    """The whole states in ``folder``, by epoch."""
    out = []
    while True:
        try:
            row = spark.read.schema(_STATE).parquet(f"{folder}/epoch-{len(out) + 1}").first()
        except AnalysisException:
            row = None
        if row is None:
            return out
        out.append(row)


def _blocks(df: DataFrame, folder: str, size: int, batch_rows: int, seed: int, id_col: str) -> tuple[DataFrame, int]:
    """(training blocks and, as batch -1, validation blocks; number of batches), written once."""
    spark = df.sparkSession
    try:
        batches = spark.read.parquet(f"{folder}/batches").first()[0]
    except AnalysisException:
        batches = max(1, -(-df.filter("_split = 'train'").count() // batch_rows))
        number = F.when(F.col("_split") == "train", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(batches))).otherwise(-1).cast("int")
        rows = df.withColumn("_batch", number).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, batch_rows // BLOCK_ROWS))))
        rows = rows.repartition("_batch", "_salt").sortWithinPartitions("_batch").select("_batch", "_label", "_clean")
        rows.mapInArrow(_pack(size), _BLOCK).write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/blocks")
        spark.createDataFrame([(batches,)], "batches int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches")
    return spark.read.schema(_BLOCK).parquet(f"{folder}/blocks"), batches


def train_epochs(df: DataFrame, text_col: str, label_col: str, id_col: str, labels: Sequence[str], folder: str, epochs: int = 5, patience: int = 2,
                 batch_rows: int = BATCH_ROWS, size: int = 1 << 16, rate: float = 0.01, decay: float = 0.01, test_frac: float = 0.2, seed: int = 42,
                 max_tokens: int | None = None) -> EpochResult:
    """Train on the exact stratified split (L4) of ``df``; ``label_col`` has class
    numbers, ``labels`` their names. ``folder`` is a shared folder of this run alone."""
    require_columns(df, [text_col, label_col, id_col])
    spark = df.sparkSession
    data = df.select(F.col(id_col), F.col(text_col), F.col(label_col).cast("int").alias("_label")).filter(F.col(id_col).isNotNull() & F.col("_label").isNotNull())
    split = stratified_split(data, "_label", id_col, test_frac, seed, split_col="_split")
    clean = with_clean_text(split, text_col, max_tokens).withColumn("_clean", F.coalesce("_clean", F.lit("")))
    blocks, batches = _blocks(clean, folder, size, batch_rows, seed, id_col)
    held_out = blocks.filter("batch = -1")
    states = _states(spark, folder)
    adam = Adam.zero(len(labels), size)
    if states:
        adam = Adam(*(np.frombuffer(states[-1][c]).reshape(len(labels), -1) for c in ("weights", "m", "v")), states[-1]["step"])
    steps = {b: blocks.filter(F.col("batch") == b).rdd for b in range(batches)} if not _ended(states, epochs, patience) else {}
    while not _ended(states, epochs, patience):
        epoch = len(states) + 1
        for b in batch_order(batches, seed, epoch):
            shared = spark.sparkContext.broadcast(adam.weights)
            g, n = steps[b].treeAggregate((0.0, 0), lambda a, r, w=shared: _plus(a, gradient(w.value, *_arrays(r))), _plus)
            shared.destroy()
            if n:
                adam.update(g / n, rate, decay)
        found = _predicted(held_out, adam.weights)
        m = classification_metrics(found, "label", "pred").first().asDict()
        values = [float(m[c] or 0) for c in ("accuracy", "precision", "recall", "f1")]
        state = (epoch, adam.step, *(bytearray(x.tobytes()) for x in (adam.weights, adam.m, adam.v)), *values)
        spark.createDataFrame([state], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch}")
        states = [*states, spark.read.schema(_STATE).parquet(f"{folder}/epoch-{epoch}").first()]
    best = _best(states)
    model = EpochModel(np.frombuffer(states[best]["weights"]).reshape(len(labels), -1), list(labels), max_tokens)
    metrics = [{c: r[c] for c in ("epoch", "accuracy", "precision", "recall", "f1")} for r in states]
    return EpochResult(model, metrics, best + 1, split.select(id_col, F.col("_label").alias(label_col), F.col("_split").alias("split")))


def _plus(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _best(states: list) -> int:
    """The first of the epochs with the largest F1."""
    return max(range(len(states)), key=lambda i: (states[i]["f1"], -i))


def _ended(states: list, epochs: int, patience: int) -> bool:
    return bool(states) and (len(states) >= epochs or len(states) - 1 - _best(states) >= patience)


def _predicted(blocks: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                labels, *rest = _arrays(r)
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(probabilities(shared.value, *rest).argmax(axis=1).astype(np.int32))], names=["label", "pred"])

    return blocks.drop("batch").mapInArrow(run, "label int, pred int")


class EpochScorer(Scorer):
    """A saved epoch model behind the scorer interface (registry name 'epochs')."""

    name = "epochs"

    def __init__(self, model: EpochModel):
        self.model = model

    def score(self, df, text_col, id_col=None, prefix="sentiment_"):
        return self.model.predict(df, text_col, prefix)

    def scores(self, df, text_col, id_col, prefix):
        cols = [id_col] if id_col else []
        return self.score(df.select(*cols, text_col), text_col, id_col, prefix).drop(text_col)


register_scorer("epochs", EpochScorer)
