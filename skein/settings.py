"""What a run can set from outside, as settings of its session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skein import schemas as S

#: Search mode: exact, fast, probe, null.
MODE = "spark.skein.search.mode"
#: Early radius in thousandths; 0 turns it off.
RADIUS = "spark.skein.early.radiusMilli"


def search_mode(spark: SparkSession) -> str:
    return spark.conf.get(MODE, None) or "exact"


def early_radius(spark: SparkSession) -> float:
    """The session's radius; what is no number counts as unset."""
    found = spark.conf.get(RADIUS, None)
    try:
        return S.EARLY_RADIUS if found is None else float(found) / 1000
    except ValueError:
        return S.EARLY_RADIUS
