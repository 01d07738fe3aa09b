"""The index: quantized references partitioned by key, their boxes, and a metadata row that readers check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas as S
from skein.functions import vectors as V


def bounds(refs: DataFrame) -> DataFrame:
    """part_key, n, frauds, and lo0..hi13: at most 256 rows, one partial sum per task."""
    return refs.groupBy("part_key").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("frauds"), *(F.min(c).alias(f"lo{i}") for i, c in enumerate(S.Q)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(S.Q)))


#: Cells that a frequent partition is cut into at most.
CELLS = 256


def cuts(refs: DataFrame, boxes: DataFrame, rows: int) -> DataFrame:
    """part_key, dim, cuts: for partitions of more than so many rows, values of their widest dimension that cut them into cells of about as many. At most 256 rows."""
    lo, hi = ([F.col(f"{x}{i}") for i in range(len(S.Q))] for x in ("lo", "hi"))
    wide = boxes.filter(F.col("n") > rows).select("part_key", F.least(F.lit(CELLS), F.ceil(F.col("n") / rows)).cast("int").alias("cells"), V.widest(lo, hi).alias("dim"))
    values = refs.join(F.broadcast(wide), "part_key").groupBy("part_key", "cells", "dim").agg(F.percentile_approx(_widest_value(), [i / CELLS for i in range(1, CELLS)], 10_000).alias("p"))
    return values.select("part_key", "dim", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("cells") - 1), lambda i: F.get("p", F.floor(i * CELLS / F.col("cells")).cast("int") - 1))).alias("cuts"))


def _widest_value():
    return F.get(F.array(*(F.col(c).cast("int") for c in S.Q)), F.col("dim"))


def with_cells(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with their part_key made finer: the partition times CELLS, and the cell."""
    cell = F.coalesce(F.size(F.filter("cuts", lambda c: c <= _widest_value())), F.lit(0))
    return rows.join(F.broadcast(cut), "part_key", "left").withColumn("part_key", F.col("part_key") * CELLS + F.when(F.col("cuts").isNotNull(), cell).otherwise(0)).drop("dim", "cuts")


def quantized(rows: DataFrame, vector: str = "vector", kind: str = "float") -> DataFrame:
    """rows with q0..q13 and part_key in place of an array of features."""
    out = rows.select(*(c for c in rows.columns if c != vector), *(V.quantize(F.col(vector)[i].cast(kind), kind).alias(c) for i, c in enumerate(S.Q)))
    return out.withColumn("part_key", V.partition_key())


def write_index(refs: DataFrame, path: str) -> None:
    """refs: ref_id, label, q0..q13, part_key. An empty set of references is an error."""
    rows = refs.select("ref_id", "label", *S.Q, "part_key")
    rows.write.partitionBy("part_key").mode("overwrite").parquet(f"{path}/refs")
    stored = refs.sparkSession.read.schema(rows.schema).parquet(f"{path}/refs")
    n = stored.count()
    if not n:
        raise ValueError("an index needs references")
    bounds(stored).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    meta = refs.sparkSession.createDataFrame([(S.INDEX_VERSION, S.DIM, S.SCALE, n)], "version int, dim int, scale int, n bigint")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """References and bounds, after checks of version, layout and count."""
    meta = spark.read.parquet(f"{path}/meta").collect()
    if len(meta) != 1:
        raise ValueError("an index has one metadata row")
    m = meta[0]
    if (m["version"], m["dim"], m["scale"]) != (S.INDEX_VERSION, S.DIM, S.SCALE):
        raise ValueError(f"index version {m['version']}, {m['dim']} dimensions, scale {m['scale']} can't be read")
    refs = spark.read.parquet(f"{path}/refs")
    boxes = spark.read.parquet(f"{path}/bounds")
    total = boxes.agg(F.sum("n").alias("n")).first()["n"]
    if total != m["n"] or refs.count() != m["n"]:
        raise ValueError("the index has another number of references than its metadata says")
    return refs, boxes


def stats(boxes: DataFrame) -> DataFrame:
    """n, partitions and frauds of an index."""
    return boxes.agg(F.sum("n").alias("n"), F.count("*").alias("partitions"), F.sum("frauds").alias("frauds"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row evaluation report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_line(report: DataFrame):
    """The report as one line of text: name=value, in column order."""
    return report.select(F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in report.columns)).alias("line"))
