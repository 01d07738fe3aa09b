"""Values at exact ranks of a column, without gathering or sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_shares(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name, the value at place min(floor(n * share), n - 1) of the sorted column, from 0.

    Equal values are counted first; the counts are range-partitioned; the driver sees one total per
    partition; only partitions that hold a place asked for are ranked. Null if there is no row.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(column).withColumn("part", F.spark_partition_id()).persist()
    try:
        totals = sorted((r["part"], r["n"], r["lo"]) for r in parts.groupBy("part").agg(F.sum("n").alias("n"), F.min(column).alias("lo")).collect())
        totals.sort(key=lambda x: x[2])
        n, before, start = sum(x[1] for x in totals), {}, 0
        for part, size, _ in totals:
            before[part] = start
            start += size
        places = {name: min(int(n * p), n - 1) for name, p in shares.items()}
        values = {}
        if n:
            hit = [p for p, b in before.items() if any(b <= k < b + dict((x[0], x[1]) for x in totals)[p] for k in places.values())]
            base = F.element_at(F.create_map(*(F.lit(x) for p in hit for x in (p, before[p]))), F.col("part"))
            upto = parts.filter(F.col("part").isin(hit)).withColumn("upto", base + F.sum("n").over(Window.partitionBy("part").orderBy(column)))
            wanted = None
            for name, k in places.items():
                one = F.min(F.when(F.col("upto") > k, F.col(column))).alias(name)
                wanted = [one] if wanted is None else [*wanted, one]
            values = upto.agg(*wanted).first().asDict()
        kind = df.schema[column].dataType.simpleString()
        return df.sparkSession.createDataFrame([tuple(values.get(name) for name in shares)], ", ".join(f"{name} {kind}" for name in shares))
    finally:
        parts.unpersist()
