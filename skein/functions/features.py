"""Features of a transaction as columns, in single or double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schemas as S


def divide(a: Column, b: Column | float, kind: str) -> Column:
    """a / b rounded once to `kind`: Spark divides floats in double, which then rounds to the same float."""
    b = F.lit(b).cast(kind) if not isinstance(b, Column) else b.cast(kind)
    return (a.cast(kind) / b).cast(kind)


def clamp01(x: Column, kind: str) -> Column:
    """x held to 0..1; NaN stays NaN."""
    zero, one = F.lit(0).cast(kind), F.lit(1).cast(kind)
    return F.when(F.isnan(x), x).otherwise(F.greatest(zero, F.least(one, x)))


def flag(x: Column, yes: int, no: int, kind: str) -> Column:
    return F.when(x, F.lit(yes)).otherwise(F.lit(no)).cast(kind)


def mcc_risk(mcc: Column, kind: str) -> Column:
    """Dictionary lookup with a default; a ten-entry literal map needs no join."""
    known = F.create_map(*(F.lit(x) for kv in S.MCC_RISK.items() for x in kv))
    return F.coalesce(F.element_at(known, mcc), F.lit(S.MCC_DEFAULT)).cast(kind)


def minutes_since(epoch: Column, last: Column, signed: bool) -> Column:
    """Whole minutes, cut towards zero: absolute, or signed and at least 0."""
    gap = epoch - last
    whole = F.floor(F.abs(gap) / 60).cast("bigint")
    return F.when(gap < 0, F.lit(0).cast("bigint")).otherwise(whole) if signed else whole


def minutes_signed(epoch: Column, last: Column) -> Column:
    """Whole minutes with their sign, cut towards zero."""
    gap = epoch - last
    whole = F.floor(F.abs(gap) / 60).cast("bigint")
    return F.when(gap < 0, -whole).otherwise(whole)


def features(kind: str = "float", signed_minutes: bool = False) -> list[Column]:
    """The 14 features of a transaction (columns as `ingest.transactions` names them)."""
    c, ts = F.col, F.col("requested_ts")
    ratio = F.when(c("customer_avg") > 0, clamp01(divide(divide(c("amount"), c("customer_avg"), kind), S.AMOUNT_RATIO, kind), kind)).otherwise(F.lit(1).cast(kind))
    none, minutes = F.lit(-1).cast(kind), minutes_since(c("epoch"), c("last_epoch"), signed_minutes)
    has_last = c("last_epoch").isNotNull()
    out = [
        clamp01(divide(c("amount"), S.MAX_AMOUNT, kind), kind),
        clamp01(divide(c("installments"), S.MAX_INSTALLMENTS, kind), kind),
        ratio,
        divide(F.hour(ts), 23.0, kind),
        divide(F.weekday(ts), 6.0, kind),
        F.when(has_last, clamp01(divide(minutes, S.MAX_MINUTES, kind), kind)).otherwise(none),
        F.when(has_last, clamp01(divide(c("last_km"), S.MAX_KM, kind), kind)).otherwise(none),
        clamp01(divide(c("km_home"), S.MAX_KM, kind), kind),
        clamp01(divide(c("tx_count_24h"), S.MAX_TX_COUNT, kind), kind),
        flag(c("is_online"), 1, 0, kind),
        flag(c("card_present"), 1, 0, kind),
        flag(c("merchant_known"), 0, 1, kind),
        mcc_risk(c("mcc"), kind),
        clamp01(divide(c("merchant_avg"), S.MAX_MERCHANT_AVG, kind), kind),
    ]
    return [x.alias(f"v{i}") for i, x in enumerate(out)]
