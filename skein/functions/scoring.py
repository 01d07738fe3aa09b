"""Decisions from neighbour counts, and evaluation scores from error counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schemas as S


def score(count: Column) -> Column:
    """Frauds among the neighbours over the fixed number of neighbours; a missing neighbour counts as legitimate."""
    return F.coalesce(count, F.lit(0)).cast("double") / F.lit(float(S.NEIGHBOURS))


def approved(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) < 3


def decision_json(count: Column) -> Column:
    return F.to_json(F.struct(approved(count).alias("approved"), score(count).alias("fraud_score")))


def edge(expected_score: Column) -> Column:
    return F.abs(expected_score - 0.6) < 1e-9


def confusion(expected_approved: Column, actual_approved: Column, failed: Column | None = None) -> list[Column]:
    """tp, tn, fp, fn, errors: fraud is the positive class, a failed request is neither."""
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    a, e = actual_approved & ~bad, expected_approved
    d = ~actual_approved & ~bad
    return [F.count_if(d & ~e).alias("tp"), F.count_if(a & e).alias("tn"), F.count_if(d & e).alias("fp"), F.count_if(a & ~e).alias("fn"), F.count_if(bad).alias("errors")]


def weighted(fp: Column, fn: Column, errors: Column) -> Column:
    return S.FP_WEIGHT * fp + S.FN_WEIGHT * fn + S.ERROR_WEIGHT * errors


def _rate(x: Column, n: Column) -> Column:
    return F.when(n > 0, x.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def p99_score(ms: Column) -> Column:
    return F.when(ms <= 0, F.lit(0.0)).when(ms > S.P99_MAX_MS, F.lit(S.CUT)).otherwise(S.SCORE_K * F.log10(F.lit(1000.0) / F.greatest(ms, F.lit(S.P99_MIN_MS))))


def detection_score(tp: Column, tn: Column, fp: Column, fn: Column, errors: Column) -> Column:
    n, e = tp + tn + fp + fn + errors, weighted(fp, fn, errors).cast("double")
    kept = S.SCORE_K * F.log10(F.lit(1.0) / F.greatest(_rate(e, n), F.lit(S.MIN_EPSILON))) - S.ERROR_BETA * F.log10(1.0 + e)
    return F.when(_rate(fp + fn + errors, n) > S.MAX_FAILURE_RATE, F.lit(S.CUT)).otherwise(kept)


def error_rates(tp: Column, tn: Column, fp: Column, fn: Column, errors: Column) -> list[Column]:
    n = tp + tn + fp + fn + errors
    e = weighted(fp, fn, errors)
    return [n.alias("n"), e.alias("weighted_errors"), (fp + fn + errors).alias("failures"), _rate(e, n).alias("epsilon"), _rate(fp + fn + errors, n).alias("failure_rate")]
