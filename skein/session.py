"""Session settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew splitting and Arrow; executor sizing is left to the cluster."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
