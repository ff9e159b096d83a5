"""Order statistics of a column without sorting it: a sketch brackets the place, counts make it exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows among which the place is looked up at once, and the accuracy of the sketch.
FEW, ACCURACY = 10_000, 5_000


def kth_smallest(df: DataFrame, k: int, value: str, tie: str | None = None) -> tuple | None:
    """``(value, tie)`` of the k-th row (from 1) in the order of both columns; None if there are fewer rows.

    Each round is two aggregations over what is left: quantiles of a mergeable sketch on either side
    of the place, and how many rows lie below and at them. Those leave about a thousandth, or
    one value, whose rows are told apart by ``tie`` in the same way; at most ``FEW`` rows come to the
    driver. ``df`` is read several times and should be a written table. Null values do not count.
    """
    left = df.select(F.col(value).alias("v"), *([F.col(tie).alias("t")] if tie else [])).where("v is not null")
    n, place = left.count(), k
    if not 0 < k <= n:
        return None
    while n > FEW:
        share = (place - 0.5) / n
        a, b = left.agg(F.percentile_approx("v", [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)], ACCURACY)).first()[0]
        a_, b_ = F.lit(a), F.lit(b)
        below, to, until, through = left.agg(*[F.count_if(c) for c in (F.col("v") < a_, F.col("v") <= a_, F.col("v") < b_, F.col("v") <= b_)]).first()
        for low, high, inside in ((0, below, F.col("v") < a_), (below, to, None), (to, until, (F.col("v") > a_) & (F.col("v") < b_)), (until, through, None), (through, n, F.col("v") > b_)):
            if low < place <= high:
                break
        if inside is None:
            found = a if high == to else b
            if not tie:
                return found, None
            return found, kth_smallest(left.where(F.col("v") == F.lit(found)), place - low, "t")[0]
        left, n, place = left.where(inside), high - low, place - low
    rows = left.orderBy(*left.columns).limit(place).collect()  # at most FEW
    return rows[-1]["v"], rows[-1]["t"] if tie else None


def smallest(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    """The k first rows in the order of ``value`` and ``tie``, which is different for rows of equal value; all if there are fewer."""
    last = kth_smallest(df, k, value, tie)
    if last is None:
        return df if k > 0 else df.limit(0)
    v, t = (F.lit(x) for x in last)
    return df.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(tie) <= t)))
