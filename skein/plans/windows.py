"""Running values over groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.store import stored


def running_mean(rows: DataFrame, group: str, bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """rows with the mean of value over all rows of its group up to it. bucket rises with the order.

    A group is cut into its buckets: sums of those, one row each, are summed up over the group, and only
    the rows of one bucket are ordered in one task. So a group with a third of all rows is many tasks.
    """
    keyed = rows.withColumn("_b", bucket).withColumn("_v", value)
    sums = keyed.groupBy(group, "_b").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_at"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    base = stored(base, "bucket-sums")  # so that a hot bucket can be split in the join
    within = Window.partitionBy(group, "_b").orderBy(*order)
    joined = keyed.withColumn("_ws", F.sum("_v").over(within)).withColumn("_wn", F.count("_v").over(within))
    joined = joined.join(base, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_at")))
    n = F.col("_n") + F.col("_wn")
    return joined.withColumn(out, F.when(n > 0, (F.col("_s") + F.coalesce("_ws", F.lit(0.0))) / n)).drop("_b", "_g", "_at", "_v", "_ws", "_wn", "_s", "_n")
