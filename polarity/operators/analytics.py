"""Aggregations over scored tables.

All are single ``groupBy`` plans with algebraic aggregates (partial
aggregation before the shuffle), so a hot key costs one row per map task.
Only the box statistics need more: exact quartiles are taken over
``(value, count)`` pairs that are pre-aggregated on the full key, so a hot
group is spread over many tasks before its quartiles are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarity.schemas import SCORE_CLASSES, require_columns


def mean_scores(df: DataFrame, group_cols: Sequence[str], prefix: str = "sentiment_",
                classes: Sequence[str] = SCORE_CLASSES) -> DataFrame:
    """A1/A2: mean of each score per group (nulls skipped) and the row count.
    Groups without rows do not appear."""
    cols = [f"{prefix}{c}" for c in classes]
    require_columns(df, [*group_cols, *cols])
    return df.groupBy(*group_cols).agg(
        *[F.avg(c).alias(cls) for c, cls in zip(cols, classes)],
        F.count(F.lit(1)).alias("n_rows"))


def overall_mean(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A3: one row with the mean (null on empty input)."""
    require_columns(df, [col])
    return df.agg(F.avg(col).alias(name or f"mean_{col}"))


def label_distribution(df: DataFrame, label_col: str, include_null: bool = False) -> DataFrame:
    """A4: ``(label, n, pct)`` sorted by ``n`` descending.

    ``include_null=False`` drops unlabelled rows (they are not counted in the
    denominator either); ``True`` keeps them as a null label. The counts, a
    row per label, are kept, so the input is read once; the total is one row.
    """
    from polarity.session import ensure_checkpoint_dir
    require_columns(df, [label_col])
    counted = F.lit(1) if include_null else F.col("label")  # a null label counts 0
    counts = df.select(F.col(label_col).alias("label")).groupBy("label").agg(F.count(counted).alias("n")).filter("n > 0")
    ensure_checkpoint_dir(df.sparkSession)
    counts = counts.checkpoint(eager=True)
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return (counts.join(F.broadcast(total)).withColumn("pct", F.lit(100.0) * F.col("n") / F.col("_total")).drop("_total")
            .orderBy(F.desc("n"), F.asc_nulls_last("label")))


def agreement(df: DataFrame, label_a: str, label_b: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """A5: percentage of rows where both labels are equal; a null label never agrees."""
    require_columns(df, [label_a, label_b, *group_cols])
    same = F.coalesce(F.col(label_a) == F.col(label_b), F.lit(False))
    return df.groupBy(*group_cols).agg(
        (F.lit(100.0) * F.avg(F.when(same, 1.0).otherwise(0.0))).alias("agreement_pct"),
        F.count(F.lit(1)).alias("n_rows"))


def accuracy(df: DataFrame, pred_col: str, expected_col: str) -> DataFrame:
    """Accuracy per expected class and overall in one pass (``rollup``).

    The overall row has ``expected = '__all__'``.
    """
    require_columns(df, [pred_col, expected_col])
    hit = F.coalesce(F.col(pred_col) == F.col(expected_col), F.lit(False))
    out = df.rollup(expected_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias("correct"),
        F.grouping(expected_col).alias("_g"))
    return out.select(
        F.when(F.col("_g") == 1, F.lit("__all__")).otherwise(F.col(expected_col).cast("string"))
        .alias("expected"),
        "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"))


def confusion(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    require_columns(df, [label_col, pred_col])
    return df.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1.

    Computed from the confusion counts (at most classes^2 rows). A class that
    is never predicted has precision 0; a class without support has weight 0.
    """
    cm = confusion(df, label_col, pred_col)
    # each confusion cell counts once as support of its true class and once
    # as a prediction of its predicted class: one aggregation per class
    roles = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp"))))
    per = (cm.select(roles.alias("r")).select("r.*")
           .groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                               F.sum("tp").alias("tp")))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.withColumns({"p": prec, "r": rec})
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0,
                                     2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    n = F.sum("support")
    return per.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / n).alias("f1"),
        n.cast("bigint").alias("n_rows"))


def correlation(df: DataFrame, col_a: str, col_b: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of two score columns."""
    require_columns(df, [col_a, col_b, *group_cols])
    return df.groupBy(*group_cols).agg(F.corr(col_a, col_b).alias("pearson"))


def mean_matrix(df: DataFrame, x_col: str, y_col: str, value_col: str,
                x_values: Sequence | None = None, wide: bool = False) -> DataFrame:
    """Mean of ``value_col`` per (y, x). Long form by default; ``wide``
    pivots x into columns (give ``x_values`` to avoid a distinct pass).
    Null keys are dropped."""
    require_columns(df, [x_col, y_col, value_col])
    src = df.filter(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    if not wide:
        return src.groupBy(y_col, x_col).agg(F.avg(value_col).alias("mean_value"))
    return src.groupBy(y_col).pivot(x_col, list(x_values) if x_values else None).agg(F.avg(value_col))


def entity_matrix(means: DataFrame, entity_col: str, measures: Sequence[str] | None = None) -> DataFrame:
    """A10: entity x measure long table from a table of means (A1)."""
    measures = list(measures or [c for c in means.columns if c != entity_col])
    require_columns(means, [entity_col, *measures])
    return means.unpivot([entity_col], measures, "measure", "value")


def box_stats(long_df: DataFrame, group_cols: Sequence[str], value_col: str = "score",
              exact: bool = True, accuracy: int = 10000, blocks: int | None = None) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at 1.5 IQR, outliers.

    ``exact=True``: rows are first counted per (group, value), a partial
    aggregation, and the pairs are dealt over blocks of (group, value), so the
    tasks stay bounded however many distinct values a group has (see
    ``_box_balanced``). ``exact=False`` uses ``percentile_approx`` (a bounded
    sketch) and reads the input twice. Fences, a row per group, are joined by
    broadcast when their size allows.
    """
    require_columns(long_df, [*group_cols, value_col])
    v = F.col(value_col)
    src = long_df.filter(v.isNotNull())
    if exact:
        pairs = src.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
        return _box_balanced(pairs, list(group_cols), value_col, blocks)
    qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = src.groupBy(*group_cols).agg(F.percentile_approx(v, qs, accuracy).alias("_q"))
    q = _few(q.select(*[F.col(c).alias(f"_q_{c}") for c in group_cols], "_q"))
    rows = src.join(q, _null_safe_on(src, q, group_cols, "_q_"), "inner")
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
    return rows.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(q1).alias("q1"), F.max(med).alias("median"), F.max(q3).alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(~inside, 1).otherwise(0)).cast("bigint").alias("n_outliers"))


# Groups whose fences (a few numbers each) are broadcast; more are joined.
FEW_GROUPS = 100_000


def _few(groups: DataFrame) -> DataFrame:
    """A checkpointed table of one row per group, marked for broadcast when it
    has at most ``FEW_GROUPS`` rows."""
    from polarity.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(groups.sparkSession)
    groups = groups.checkpoint(eager=True)
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


QUARTILES = (0.25, 0.5, 0.75)


def _box_balanced(pairs: DataFrame, group_cols: list[str], value_col: str,
                  blocks: int | None) -> DataFrame:
    """Exact quartiles and whiskers with bounded tasks.

    1. the (group, value, count) pairs are range-partitioned on (group,
       value) into blocks (a hot group spans many blocks) and checkpointed,
       so block ids are fixed and the pairs are read again without being
       recomputed;
    2. counts per (group, block) and their running sums give, for every
       needed rank (floor and ceil of ``(n - 1) * q``), the block holding it;
    3. only the rows of those blocks are ranked (one block per task), and
       the quartile is ``(ceil - h) * v_floor + (h - floor) * v_ceil`` as in
       Spark's ``percentile``;
    4. whiskers and outliers: one aggregation of the pairs against the
       per-group fences.
    """
    from polarity.session import ensure_checkpoint_dir
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    nblocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value_col)
    gk = F.to_json(F.struct(*[F.col(c) for c in group_cols])) if group_cols else F.lit("{}")
    ranged = (pairs.withColumn("_gk", gk).repartitionByRange(nblocks, "_gk", value_col)
              .withColumn("_blk", F.spark_partition_id()).checkpoint(eager=True))
    per_blk = ranged.groupBy("_gk", "_blk").agg(F.sum("_cnt").alias("_c"))
    wg = Window.partitionBy("_gk")
    per_blk = per_blk.withColumns({
        "_before": F.coalesce(F.sum("_c").over(wg.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)),
        "_n": F.sum("_c").over(wg)})
    # needed ranks (0-based) per group: floor and ceil of h = (n - 1) * q
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(q).alias("q"), F.lit(w).alias("w"))
                                 for i, q in enumerate(QUARTILES) for w in (0, 1)]))
    targets = (per_blk.select("_gk", "_n").dropDuplicates(["_gk"]).select("_gk", "_n", wanted.alias("t"))
               .select("_gk", "_n", "t.qi", "t.q", "t.w",
                       ((F.col("_n") - 1) * F.col("t.q")).alias("_h")))
    targets = targets.withColumn(
        "_r", F.when(F.col("w") == 0, F.floor("_h")).otherwise(F.ceil("_h")).cast("bigint"))
    loc = (per_blk.join(targets.drop("_n"), "_gk")
           .filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c")))
           .select("_gk", "_blk", "qi", "w", "_h", (F.col("_r") - F.col("_before")).alias("_off")))
    cand = ranged.join(loc.select("_gk", "_blk").distinct(), ["_gk", "_blk"], "inner")
    run = F.sum("_cnt").over(Window.partitionBy("_gk", "_blk").orderBy(value_col)
                             .rowsBetween(Window.unboundedPreceding, 0))
    cand = cand.withColumn("_end", run)
    hit = (cand.join(loc, ["_gk", "_blk"], "inner")
           .filter((F.col("_off") >= F.col("_end") - F.col("_cnt")) & (F.col("_off") < F.col("_end"))))
    per_q = hit.groupBy("_gk", "qi").agg(
        F.max(F.when(F.col("w") == 0, v)).alias("_v0"), F.max(F.when(F.col("w") == 1, v)).alias("_v1"),
        F.max("_h").alias("_h"))
    lo_pos, hi_pos = F.floor("_h"), F.ceil("_h")
    quant = F.when(lo_pos == hi_pos, F.col("_v0")).otherwise(
        (hi_pos - F.col("_h")) * F.col("_v0") + (F.col("_h") - lo_pos) * F.col("_v1"))
    stats = per_q.groupBy("_gk").agg(*[F.max(F.when(F.col("qi") == i, quant)).alias(name)
                                       for i, name in enumerate(("q1", "median", "q3"))])
    stats = _few(stats)
    fences = stats.select("_gk", "q1", "q3")
    fences = F.broadcast(fences) if fences.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else fences
    inside = (v >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & \
             (v <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per (group, block) first, then per group
    part = ranged.join(fences, "_gk", "inner").groupBy("_gk", *group_cols, "_blk").agg(
        F.sum("_cnt").alias("n"), F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_cnt")).otherwise(0)).alias("n_outliers"))
    whisk = part.groupBy("_gk", *group_cols).agg(
        F.sum("n").cast("bigint").alias("n"), F.min("whisker_low").alias("whisker_low"),
        F.max("whisker_high").alias("whisker_high"), F.sum("n_outliers").cast("bigint").alias("n_outliers"))
    return whisk.join(stats, "_gk", "inner").select(
        *group_cols, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str], prefix: str):
    """Join condition on group columns where null keys match each other."""
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[f"{prefix}{c}"])
        cond = e if cond is None else cond & e
    return cond


def distinct_labels(df: DataFrame, label_col: str) -> DataFrame:
    """Distinct labels, null included."""
    require_columns(df, [label_col])
    return df.select(F.col(label_col).alias("label")).distinct()


def row_counts(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Rows per group."""
    require_columns(df, group_cols)
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"))


def confidence(df: DataFrame, score_cols: Sequence[str], name: str = "confidence") -> DataFrame:
    """A14 (row): the largest score of a row (nulls skipped)."""
    require_columns(df, score_cols)
    return df.withColumn(name, F.greatest(*[F.col(c) for c in score_cols]))


def mean_confidence(df: DataFrame, score_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """A14 (group): mean and minimum of the row confidence per group."""
    c = F.greatest(*[F.col(x) for x in score_cols])
    return df.groupBy(*group_cols).agg(F.avg(c).alias("mean_confidence"),
                                       F.min(c).alias("min_confidence"),
                                       F.count(F.lit(1)).alias("n_rows"))
