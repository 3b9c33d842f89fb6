"""Top-k per group (L1), repeatable stratified sample (L3) and exact
stratified split (L4).

Randomness is a hash of ``seed:id`` (md5), so every run and every engine
draws the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarity.schemas import require_columns


def seeded_hash(id_col: str, seed: int) -> Column:
    """32 hex digits of md5('seed:id'); string order = numeric order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def first_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                      k: int | None, rank_col: str | None = None) -> DataFrame:
    """L1: the first ``k`` rows per group in ``order_cols`` order, which
    should identify rows (ties are drawn in any order). ``None``: all rows.

    ``row_number() <= k`` with a literal ``k`` is planned as a group limit
    that runs before the shuffle, so a hot group sends only ``k`` rows per
    task.
    """
    require_columns(df, list(group_cols))
    if k is None and rank_col is None:
        return df
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    name = rank_col or "_rk"
    out = df.withColumn(name, F.row_number().over(w))
    out = out if k is None else out.filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def stratified_sample(df: DataFrame, label_col: str, id_col: str, num_examples: int = 10,
                      seed: int = 42) -> DataFrame:
    """L3: per label ``min(num_examples // n_labels, rows of the label)``
    rows (a null label counts in ``n_labels`` but is never drawn); when that
    draws nothing, ``min(num_examples, n)`` rows of all. Sorted by label.

    The label count is one row, joined by broadcast; the draws are top-k
    limits that run before the shuffle.
    """
    require_columns(df, [label_col, id_col])
    lab = F.col(label_col)
    keyed = df.withColumn("_h", seeded_hash(id_col, seed))
    # candidates: the first num_examples rows of every label (null included),
    # a group limit applied before the shuffle. They hold every label and
    # every row any rule below can draw, so all later steps run on at most
    # num_examples x labels rows, which are kept.
    w = Window.partitionBy(label_col).orderBy("_h", id_col)
    cand = keyed.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= num_examples)
    from polarity.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    cand = cand.checkpoint(eager=True)
    sizes = cand.agg(F.count_distinct(lab).alias("_named"),
                     F.max(F.when(lab.isNull(), 1).otherwise(0)).alias("_null"))
    n_labels = F.col("_named") + F.col("_null")
    cand = cand.join(F.broadcast(sizes.select("_named", "_null"))).withColumn("_k", F.floor(F.lit(num_examples) / n_labels))
    drawn = cand.filter(lab.isNotNull() & (F.col("_rk") <= F.col("_k")))
    # when no label can give a row, the first num_examples of all rows instead
    nothing = cand.filter((F.col("_k") == 0) | (F.col("_named") == 0)).orderBy("_h", id_col).limit(num_examples)
    return (drawn.unionByName(nothing).orderBy(F.asc_nulls_last(label_col), "_h", id_col)
            .drop("_h", "_rk", "_k", "_named", "_null"))


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_frac: float = 0.2,
                     seed: int = 42, bucket_digits: int = 5, split_col: str = "split") -> DataFrame:
    """L4: exact stratified split. Per label the first ``round(test_frac * n)``
    rows in the order of (hash, id) are ``val``, the rest ``train``.

    Labels and ids are counted per (label, hash bucket) (``16 **
    bucket_digits`` buckets, a partial aggregation); the running counts over
    that small table find each label's boundary bucket, and only the ids of
    that bucket are ranked, which gives one boundary pair (hash, id) per label.
    Rows are then marked by comparing their own pair with it: the only join is
    with a table of a row per label, so other columns are never shuffled.
    """
    require_columns(df, [label_col, id_col])
    keys = df.select(F.col(label_col).alias("_l"), seeded_hash(id_col, seed).alias("_h"), F.col(id_col).alias("_i"))
    keys = keys.withColumn("_b", F.substring("_h", 1, bucket_digits))
    counts = keys.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_c"))
    wl = Window.partitionBy("_l")
    run = wl.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_cum": F.sum("_c").over(run), "_n": F.sum("_c").over(wl)})
    counts = counts.withColumn("_m", F.floor(F.col("_n") * float(test_frac) + 0.5))
    # boundary bucket: the running count reaches the target here
    bound = (counts.filter((F.col("_cum") - F.col("_c") < F.col("_m")) & (F.col("_cum") >= F.col("_m")))
             .select(F.col("_l").alias("_bl"), F.col("_b").alias("_bb"), (F.col("_m") - F.col("_cum") + F.col("_c")).alias("_need")))
    bound = _per_label(bound)
    last = (keys.join(bound, (F.col("_b") == F.col("_bb")) & F.col("_l").eqNullSafe(F.col("_bl")))
            .withColumn("_rk", F.row_number().over(Window.partitionBy("_l", "_b").orderBy("_h", "_i")))
            .filter(F.col("_rk") == F.col("_need")).select(F.col("_l").alias("_bl"), F.col("_h").alias("_bh"), F.col("_i").alias("_bi")))
    last = _per_label(last)
    marked = df.join(last, df[label_col].eqNullSafe(F.col("_bl")), "left").withColumn("_h", seeded_hash(id_col, seed))
    is_val = (F.col("_h") < F.col("_bh")) | ((F.col("_h") == F.col("_bh")) & (F.col(id_col) <= F.col("_bi")))
    return marked.withColumn(split_col, F.when(F.coalesce(is_val, F.lit(False)), "val").otherwise("train")).drop("_h", "_bl", "_bh", "_bi")


# Labels of a split, with a few short values each, that are broadcast.
FEW_LABELS = 100_000


def _per_label(table: DataFrame) -> DataFrame:
    """A checkpointed table of one row per label, broadcast when it is short."""
    from polarity.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(table.sparkSession)
    table = table.checkpoint(eager=True)
    return F.broadcast(table) if table.limit(FEW_LABELS + 1).count() <= FEW_LABELS else table
