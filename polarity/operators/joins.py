"""Joins: size-checked broadcast and the first-match author lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its plan bounds it to this many bytes.
BROADCAST_BYTES = 64 << 20


def broadcast_checked(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it is a driver-built table (a lexicon, a
    company list) whose plan states a size of at most ``max_bytes``.

    Otherwise ``df`` is returned as it is: the optimizer broadcasts it when
    its size estimate is below ``spark.sql.autoBroadcastJoinThreshold``, and
    adaptive execution re-checks the real size at run time and keeps a
    shuffle join beyond it. No counting job is run.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return F.broadcast(df) if _driver_built(plan) and plan.stats().sizeInBytes().longValue() <= max_bytes else df


def _driver_built(plan) -> bool:
    leaves = plan.collectLeaves()
    return all(leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size()))


def first_match_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       order_col: str | None = None) -> DataFrame:
    """Left join keeping every left row once; of duplicate right keys the
    first one wins: by ``order_col``, else by its place in the input.

    The de-duplication is a partial aggregation on the right side
    (``min_by``), so a hot key does not gather its rows in one task.
    The de-duplicated side is broadcast when known to be small, else the
    optimizer and adaptive execution choose the join from its real size.
    """
    cols = [c for c in right.columns if c != right_key]
    packed = F.struct(*[F.col(c) for c in cols])
    place = F.monotonically_increasing_id() if order_col is None else F.col(order_col)
    placed = right.select(F.col(right_key), packed.alias("_row"), place.alias("_place"))
    dedup = placed.groupBy(right_key).agg(F.min_by("_row", "_place").alias("_m")).select(right_key, "_m.*")
    dedup = broadcast_checked(dedup)
    if left_key == right_key:
        return left.join(dedup, on=left_key, how="left")
    return left.join(dedup, left[left_key] == dedup[right_key], "left")
