"""Running sums over an order of many rows without one task per group.

Rows are dealt to ranges between quantiles of the order; totals of ranges give where each
range starts, and only the rows of one range are ordered among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, group: list[str], order: str, sums: list[str], ranges: int = 64, accuracy: int = 1000, then: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """rows with one row per (group, order, then); adds cum_<s>: the sum of s over the rows of its group up to this one.
    Groups are columns or pairs of columns: their ranges are metadata and go to all tasks, so that no group's rows meet in one."""
    cuts = rows.groupBy(*group).agg(F.percentile_approx(order, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(accuracy)).alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts), group).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    totals = dealt.groupBy(*group, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums])
    within = Window.partitionBy(*group, "_range").orderBy(order, *then)
    out = dealt.join(F.broadcast(starts), [*group, "_range"])
    cum: dict[str, Column] = {f"cum_{s}": F.col(f"_s_{s}") + F.sum(s).over(within) for s in sums}
    return out.withColumns(cum).drop("_range", *[f"_s_{s}" for s in sums])
