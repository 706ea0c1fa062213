"""Running sums in two levels: inside ranges of the order, and over the ranges' totals, so that no group is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order, about; their bounds are the only rows that the driver sees.
RANGES = 512


def range_bounds(df: DataFrame, order: str, ranges: int = RANGES) -> list:
    """Quantiles of a numeric column, ascending and distinct."""
    shares = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)])
    found = df.agg(F.percentile_approx(order, shares, F.lit(20 * ranges)).alias("q")).head().q
    return sorted(set(found or []))


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str = "before", ranges: int = RANGES) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group before a row in ``order`` (numeric; null first;
    rows of equal order in an order of their own). A null value adds nothing, a null group is a group.

    Ranges are cut at quantiles of ``order`` over all groups. A window holds one group's rows of one range; the sums of
    earlier ranges come from one row a group and range. Rows of one single order value stay together.
    """
    bounds = range_bounds(df, order, ranges)
    part = _bounds_below(F.col(order), F.array(*map(F.lit, bounds)), len(bounds)) if bounds else F.lit(0)
    parted = df.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(part))
    totals = parted.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.sum(value).over(Window.partitionBy(group, "_part").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1))
    summed = parted.withColumn("_inside", inside)
    both = summed.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.select(*df.columns, (F.coalesce("_inside", F.lit(0)) + F.col("_earlier")).alias(out))


def _bounds_below(value, cuts, n: int):
    """How many of n ascending bounds are less than ``value``, by halving."""
    steps = max(1, n.bit_length())
    state = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & (F.get(cuts, mid) < value)
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda s: s["lo"])
