"""Running totals and positions over a global order without a one-task window.

Rows are range-partitioned by the order; each range is totalled, the totals of the
(few hundred or thousand) ranges are accumulated, and the running value inside a range starts
from what came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph import scratch

#: Ranges at least; a session with more shuffle partitions gets as many ranges as these.
RANGES = 64


def running(df: DataFrame, order: list[str], value: str, name: str, how: str = "sum") -> DataFrame:
    """``df`` with ``name``: the sum (or max) of ``value`` from the first row through this one."""
    agg = getattr(F, how)
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    split = scratch.materialize(split, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, as many as shuffle partitions, so the side to broadcast is bounded.
    totals = split.groupBy("_range").agg(agg(value).alias("_total")).withColumn("_before", agg("_total").over(before)).drop("_total")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = split.join(F.broadcast(totals), "_range").withColumn("_inside", agg(value).over(inside))
    if how == "sum":
        return out.withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_range", "_before", "_inside")
    return out.withColumn(name, F.greatest("_inside", F.coalesce("_before", "_inside"))).drop("_range", "_before", "_inside")


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the (unique) order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")
