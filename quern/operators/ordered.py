"""Running sums over a total order without a single-partition window.

A window without PARTITION BY moves all rows into one task. Here the rows are range
partitioned, each partition keeps its own running sums, and the totals of the partitions
before it (one row a partition, so bounded by the shuffle width) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, shuffle_width


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    number: str | None = None,
) -> DataFrame:
    """Add for each name of ``sums`` the inclusive running sum of its column over ``order``.

    ``number``: also add the 1-based position under that name. ``order`` must be unique per
    row for a repeatable answer; rows with the same order values get some order. NULLs in a
    summed column count as 0. An empty input gives an empty output.
    """
    spark = df.sparkSession
    fields = dict(sums) | ({number: F.lit(1).cast("long")} if number else {})
    wide = df.select("*", *(F.coalesce(c, F.lit(0).cast("long")).alias(f"__v_{k}") for k, c in fields.items()))
    keys = [f"__o_{i}" for i in range(len(order))]
    plain = [c for c in order]
    ranged = wide.repartitionByRange(shuffle_width(spark), *plain).withColumn("__pid", F.spark_partition_id())
    ranged = materialise(ranged)
    totals = ranged.groupBy("__pid").agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in fields))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by spark.sql.shuffle.partitions
    offsets = totals.select("__pid", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in fields))
    here = Window.partitionBy("__pid").orderBy(*plain).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "__pid")
    out = out.select("*", *((F.sum(f"__v_{k}").over(here) + F.col(f"__b_{k}")).alias(k) for k in fields))
    drop = ["__pid", *keys, *(f"__{p}_{k}" for k in fields for p in "vb")]
    return out.drop(*drop)
