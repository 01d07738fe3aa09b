"""Fixed-point vectors: quantization, partition key, squared distance, box bound."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schemas as S


def quantize(x: Column, kind: str = "float") -> Column:
    """Held to -1..1, times the scale, rounded half away from zero by a cut; NaN becomes 0."""
    held = F.greatest(F.lit(-1).cast(kind), F.least(F.lit(1).cast(kind), x.cast(kind)))
    half = F.when(held >= 0, F.lit(0.5)).otherwise(F.lit(-0.5)).cast(kind)
    return F.when(F.isnan(x), F.lit(0).cast("smallint")).otherwise((held * F.lit(S.SCALE).cast(kind) + half).cast("smallint"))


def quantize_array(v: Column, kind: str = "float") -> Column:
    return F.transform(v, lambda x: quantize(x, kind))


def partition_key() -> Column:
    """Eight bits of seven predicates on q0..q13."""
    q = lambda i: F.col(f"q{i}")
    bit = lambda p, n: F.when(p, F.lit(n)).otherwise(F.lit(0))
    risk = F.when(q(12) <= 2047, 0).when(q(12) <= 4095, 16).when(q(12) <= 6143, 32).otherwise(48)
    return bit(q(5) >= 0, 1) + bit(q(9) > 0, 2) + bit(q(10) > 0, 4) + bit(q(11) > 0, 8) + risk + bit(q(2) > 4096, 64) + bit(q(8) > 2048, 128)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance in 64-bit integers, unrolled so that it compiles to straight code."""
    gaps = [x.cast("bigint") - y.cast("bigint") for x, y in zip(a, b, strict=True)]
    return reduce(add, [g * g for g in gaps])


def box_bound(q: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Least squared distance from a point to a box."""
    out = [F.greatest(a.cast("bigint") - x.cast("bigint"), x.cast("bigint") - b.cast("bigint"), F.lit(0).cast("bigint")) for x, a, b in zip(q, lo, hi, strict=True)]
    return reduce(add, [g * g for g in out])


def widest(lo: list[Column], hi: list[Column]) -> Column:
    """The dimension of the largest range, the first of equals."""
    ranges = [b.cast("int") - a.cast("int") for a, b in zip(lo, hi, strict=True)]
    top = F.greatest(*ranges)
    return F.coalesce(*(F.when(r == top, F.lit(i)) for i, r in enumerate(ranges)))


def radius_limit(radius: float = S.EARLY_RADIUS) -> int:
    """A radius in fixed point, squared; its sign has no effect."""
    return round(S.SCALE * radius) ** 2
