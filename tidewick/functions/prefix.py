"""Running sums and ranks over groups of any size: no task holds a group, and nothing but one row per partition is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the same group from the first one to this one in `order`.

    Rows are laid out by range and settled; a partition sums up what it has of each group, and what earlier partitions
    have of its first group is added. Rows that are equal in `order` may come in either order. Nulls come first and null
    groups are groups. An empty `group` means all rows.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    given = stored(rows.withColumn("_value", value))  # a range sort reads its input twice
    laid = stored(given.repartitionByRange(partitions, *keys).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each partition and group; over these, a group's rows are as many as the partitions it lies in
    sums = laid.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    earlier = (Window.partitionBy(*group) if group else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.sum("_sum").over(earlier)).where("_before is not null")
    before = before.select(F.col("_part").alias("_in"), *[F.col(c).alias(f"_of_{c}") for c in group], "_before")
    same = F.col("_part") == F.col("_in")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    # only the first group of a partition can have rows in earlier ones: a row for each partition at most
    joined = laid.withColumn("_within", F.sum("_value").over(within)).join(F.broadcast(before), same, "left")
    return joined.select(*rows.columns, (F.col("_within") + F.coalesce("_before", F.lit(0))).alias(out))


def ranked(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`, the row's number from 1 within its group in `order`."""
    return running(rows, group, order, F.lit(1).cast("long"), out)
