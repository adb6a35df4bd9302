"""Window-like operators that stay balanced when one group is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import write_out


def running_sum(rows: DataFrame, group: str, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """Adds the sum of ``value`` up to and including each row, by ``order`` within ``group``.

    No group is sorted in one task: rows are range-partitioned by (group, order), each partition is summed up, and only
    the partitions' sums of a group, as many as there are partitions, are accumulated. The order must be total. Written to the
    shared folder, since a partition's number must not change between its uses. Null values count as 0.
    """
    cut = rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    cut = write_out(cut)
    sums = cut.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(group, "_part", "_before")
    inner = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(sums, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank (long); Spark cuts each partition to k before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def max_before(value: Column, group: list[str], order: list[Column]) -> Column:
    """The largest value of the rows before this one in its (small) group."""
    return F.max(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
