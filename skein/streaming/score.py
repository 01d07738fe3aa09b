"""Payloads that arrive as text files, scored in micro-batches against an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scoring
from skein.operators import knn
from skein.plans.transactions import vectors
from skein.sources import ingest


def score_batch(payloads: DataFrame, refs: DataFrame, boxes: DataFrame) -> DataFrame:
    """payloads: id, body. id, status, approved, fraud_score; rejected payloads keep a row with status 400."""
    parsed = ingest.parse(payloads)
    good = vectors(parsed.filter("is_valid"), ["id"]).withColumnRenamed("id", "query_id")
    counts = knn.frauds(good, knn.pruned(refs, good, boxes))
    done = counts.select(F.col("query_id").alias("id"), F.lit(200).alias("status"), scoring.approved(F.col("fraud_count")).alias("approved"), scoring.score(F.col("fraud_count")).alias("fraud_score"))
    bad = parsed.filter(~F.col("is_valid")).select("id", F.lit(400).alias("status"), F.lit(None).cast("boolean").alias("approved"), F.lit(None).cast("double").alias("fraud_score"))
    return done.unionByName(bad)


def run(spark: SparkSession, source: str, index: tuple[DataFrame, DataFrame], sink: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Score all payload files (JSON lines of id and body) under source that the checkpoint has not seen, then stop.

    A batch is written to a folder of its own number, so a batch that is run again after a failure
    replaces its rows.
    """
    refs, boxes = index
    stream = spark.readStream.schema("id bigint, body string").option("maxFilesPerTrigger", files_per_batch).json(source)

    def each(batch: DataFrame, number: int) -> None:
        score_batch(batch, refs, boxes).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
