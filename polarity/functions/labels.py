"""Label rules: compound threshold and soft-max arg-max."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label thresholds on the compound score (closed bounds).
POSITIVE_AT = 0.05
NEGATIVE_AT = -0.05


def label_from_compound(c: str | Column) -> Column:
    """>= 0.05 positive, <= -0.05 negative, else neutral (null stays null)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c >= POSITIVE_AT, "positive")
            .when(c <= NEGATIVE_AT, "negative")
            .otherwise("neutral"))


def softmax(logits: str | Column) -> Column:
    """Numerically stable soft-max of an ARRAY<DOUBLE>."""
    x = F.col(logits) if isinstance(logits, str) else logits
    # each intermediate is bound once: named again, it would be computed for every element
    e = _once(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return _once(e, lambda e: _once(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), use)[0]


def argmax_label(probs: str | Column, labels: Sequence[str]) -> Column:
    """Label at the first position of the largest probability."""
    p = F.col(probs) if isinstance(probs, str) else probs
    names = F.array(*[F.lit(x) for x in labels])
    return F.try_element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
