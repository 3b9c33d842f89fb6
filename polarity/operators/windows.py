"""Rolling means over time (W1, W2) and date ordering.

W1 frames are *rows* (the last ``n`` rows in order), and a value is only
given when all ``n`` rows of the frame hold a value (the full-frame rule).

``rolling_mean`` is the plain window partitioned by entity. A very large
entity (a third of all rows, say) would sit in one task, so
``rolling_mean_balanced`` gives the same result with bounded tasks: rows are
range-partitioned on (entity, order) into blocks, each block receives the
``n - 1`` rows that precede it (its halo), and the window runs per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.schemas import require_columns
from polarity.session import ensure_checkpoint_dir


def order_key(df: DataFrame, col: str) -> Column:
    """A sortable date/time key; strings are parsed first."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(F.col(col))
    return F.col(col)


def sort_by(df: DataFrame, col: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Sort by a date/time (parsed if string) with a key tie-break."""
    return df.orderBy(order_key(df, col).asc_nulls_last(), *[F.col(c) for c in tie_break])


def _frame_exprs(value_cols: Sequence[str], n: int, w: Window, suffix: str) -> dict[str, Column]:
    return {f"{c}{suffix}": F.when(F.count(c).over(w) == n, F.avg(c).over(w)) for c in value_cols}


def rolling_mean(df: DataFrame, value_cols: Sequence[str], n: int, order_cols: Sequence[str],
                 partition_cols: Sequence[str], suffix: str = "_rolling") -> DataFrame:
    """Mean over the last ``n`` rows per entity, in ``order_cols`` order.

    Unknown value columns are skipped. ``partition_cols`` is required: a
    rolling mean without one would put all rows in one task.
    """
    if not partition_cols:
        raise ValueError("partition_cols is required (use rolling_mean_balanced for one series)")
    require_columns(df, [*order_cols, *partition_cols])
    cols = [c for c in value_cols if c in df.columns]
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols).rowsBetween(-(n - 1), 0)
    return df.withColumns(_frame_exprs(cols, n, w, suffix))


def rolling_mean_balanced(df: DataFrame, value_cols: Sequence[str], n: int,
                          order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                          blocks: int | None = None, suffix: str = "_rolling") -> DataFrame:
    """W1 with bounded tasks, for skewed entities or a single global series.

    1. range-partition on (entity, order) into ``blocks`` contiguous blocks and
       checkpoint, so that each row's block id is fixed;
    2. per (entity, block) its last ``n - 1`` rows (a top-k, limited before
       the shuffle);
    3. a block's halo = the ``n - 1`` rows of its entity just before it, found
       among those tails (at most ``(n - 1) x blocks`` rows per entity);
    4. the window runs per (entity, block) over the block's rows and halo.
    ``order_cols`` must identify rows uniquely within an entity.
    """
    require_columns(df, [*order_cols, *partition_cols])
    cols = [c for c in value_cols if c in df.columns]
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    nblocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = list(partition_cols)
    keyed = (df.repartitionByRange(nblocks, *part, *order_cols)
             .withColumn("_blk", F.spark_partition_id())
             .checkpoint(eager=True))
    if n <= 1:
        w = Window.partitionBy(*part, "_blk").orderBy(*order_cols).rowsBetween(0, 0)
        return keyed.withColumns(_frame_exprs(cols, n, w, suffix)).drop("_blk")

    tail_w = Window.partitionBy(*part, "_blk").orderBy(*[F.col(c).desc() for c in order_cols])
    tails = keyed.withColumn("_r", F.row_number().over(tail_w)).filter(F.col("_r") <= n - 1).drop("_r")
    pos_w = Window.partitionBy(*part).orderBy(*order_cols) if part else Window.orderBy(*order_cols)
    tails = tails.withColumn("_q", F.row_number().over(pos_w))
    starts = tails.groupBy(*part, "_blk").agg(F.min("_q").alias("_s"))
    wanted = (starts.select(*part, F.col("_blk").alias("_target"),
                            F.explode(F.sequence(F.col("_s") - (n - 1), F.col("_s") - 1)).alias("_q"))
              .filter(F.col("_q") >= 1))
    # entities may be null: they are matched null-safe
    wanted = wanted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(part)], "_target", F.col("_q").alias("_wq"))
    same = F.col("_q") == F.col("_wq")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    halo = (tails.join(wanted, same, "inner")
            .drop("_blk", "_q", "_wq", *[f"_w{i}" for i in range(len(part))]).withColumnRenamed("_target", "_blk")
            .withColumn("_own", F.lit(False)))
    rows = keyed.withColumn("_own", F.lit(True)).unionByName(halo)
    w = Window.partitionBy(*part, "_blk").orderBy(*order_cols).rowsBetween(-(n - 1), 0)
    return rows.withColumns(_frame_exprs(cols, n, w, suffix)).filter("_own").drop("_own", "_blk")


def daily_series(df: DataFrame, date_col: str, value_cols: Sequence[str],
                 partition_cols: Sequence[str] = (), rolling_days: int | None = None,
                 suffix: str = "_rolling") -> DataFrame:
    """Mean per (entity, day); optionally a rolling mean over the last
    ``rolling_days`` daily rows. The daily table has one row per entity and
    day, so the window is small whatever the raw volume."""
    require_columns(df, [date_col, *partition_cols])
    cols = [c for c in value_cols if c in df.columns]
    day = F.to_date(order_key(df, date_col)).alias("date")
    daily = df.groupBy(*partition_cols, day).agg(*[F.avg(c).alias(c) for c in cols],
                                                 F.count(F.lit(1)).alias("n_rows"))
    if rolling_days:
        part = list(partition_cols)
        w = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy("date") \
            .rowsBetween(-(rolling_days - 1), 0)
        daily = daily.withColumns(_frame_exprs(cols, rolling_days, w, suffix))
    return daily
