"""Stored aggregates that are merged instead of computed again.

Quantiles: one KLL sketch per group and day (Spark's own aggregate), stored
beside the group. Sketches of any days, or of rows that came later, are merged
for any period; with ``SKETCH_K`` = 400 a quantile's rank is off by less than 1 %.

Series: (sum, count) per entity and day. Each landing adds its own partial sums
under its batch number, so a landing that is run again replaces itself. The
rolling mean over an entity's last ``rolling_days`` daily rows is kept in a table
partitioned by day; after a landing only those days are written again whose
windows hold a day that it touched, late days included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polarity.operators.windows import order_key
from polarity.schemas import require_columns

SKETCH_K = 400


def quantile_states(df: DataFrame, group_cols: Sequence[str], value_col: str, k: int = SKETCH_K) -> DataFrame:
    """The groups with ``state``, a sketch of the values that aren't null; the input is read once."""
    require_columns(df, [*group_cols, value_col])
    value = F.col(value_col).cast("double")
    return df.filter(value.isNotNull()).groupBy(*group_cols).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("state"))


def merge_quantiles(states: DataFrame, group_cols: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of larger groups from those of smaller ones (fewer group columns, more days)."""
    require_columns(states, [*group_cols, "state"])
    return states.groupBy(*group_cols).agg(F.kll_merge_agg_double("state", F.lit(k)).alias("state"))


def quantiles(states: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """``n`` and a column per name with the value of that rank (0 to 1), in place of ``state``."""
    found = {name: F.kll_sketch_get_quantile_double("state", F.lit(float(r))) for name, r in ranks.items()}
    return states.withColumns({"n": F.kll_sketch_get_n_double("state"), **found}).drop("state")


def add_landing(df: DataFrame, folder: str, batch_id: int, entity_col: str, time_col: str, value_col: str, rolling_days: int) -> DataFrame:
    """Add the rows of a landing to the series in ``folder``; returns the days that were written again (date)."""
    require_columns(df, [entity_col, time_col, value_col])
    spark = df.sparkSession
    day = F.to_date(order_key(df, time_col))
    part = df.groupBy(F.col(entity_col).alias("entity"), day.alias("date")).agg(F.sum(F.col(value_col).cast("double")).alias("total"), F.count(value_col).alias("n"))
    part.write.mode("overwrite").parquet(f"{folder}/state/batch={int(batch_id)}")
    parts = spark.read.parquet(f"{folder}/state")
    daily = parts.groupBy("entity", "date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max((F.col("batch") == int(batch_id)).cast("int")).alias("touched"))
    window = Window.partitionBy("entity").orderBy("date").rowsBetween(-(rolling_days - 1), 0)
    mean = F.try_divide("total", "n")
    full = F.count(mean).over(window) == rolling_days
    series = daily.withColumns({"mean": mean, "rolling": F.when(full, F.avg(mean).over(window)), "again": F.max("touched").over(window)})
    dates = series.filter("again = 1").select("date").distinct()
    rows = series.join(dates.toDF("day"), F.col("date").eqNullSafe(F.col("day")), "left_semi").select("entity", "n", "mean", "rolling", "date")
    rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{folder}/series")
    return dates


def series(spark: SparkSession, folder: str) -> DataFrame:
    """The series as it stands: entity, date, mean, n, rolling."""
    return spark.read.parquet(f"{folder}/series").select("entity", F.col("date").cast("date").alias("date"), "mean", "n", "rolling")
