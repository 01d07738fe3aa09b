"""Transactions made from the events table, in the columns that parsed payloads have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schemas as S
from skein.functions import features as C
from skein.functions import vectors as V
from skein.plans.windows import running_mean

#: Merchant categories by merchant number modulo 11; the last is in no dictionary.
CATEGORIES = [*S.MCC_RISK, "unknown"]
#: Searches take every row whose id is divisible by this as a query.
QUERY_EVERY = 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event, with the history its payload would carry.

    All histories are running windows: nothing is gathered per user, and a merchant is known if the
    user's row for it isn't the first. Merchants are few, so their windows go by hour.
    """
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        "user_id",
        "event_type",
        (F.col("value") * 20).cast("float").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.unix_timestamp("ts").alias("epoch"),
    )
    own = Window.partitionBy("user_id").orderBy("ts", "id")
    day = Window.partitionBy("user_id").orderBy("epoch_us").rangeBetween(-86_400_000_000, 0)
    at_merchant = Window.partitionBy("user_id", "k").orderBy("ts", "id")
    e = running_mean(e, "k", F.date_trunc("hour", "ts"), ["ts", "id"], F.col("amount").cast("double"), "merchant_mean")
    mcc = F.element_at(F.array(*(F.lit(x) for x in CATEGORIES)), (F.col("k") % len(CATEGORIES) + 1).cast("int"))
    return e.withColumn("epoch_us", F.unix_micros("ts") if str(e.schema["ts"].dataType) == "TimestampType()" else F.unix_micros(F.col("ts").cast("timestamp"))).select(
        "id",
        F.col("ts").alias("requested_ts"),
        "epoch",
        "user_id",
        "k",
        "amount",
        (F.col("k") % 12 + 1).alias("installments"),
        F.avg(F.col("amount").cast("double")).over(own).cast("float").alias("customer_avg"),
        F.count("*").over(day).alias("tx_count_24h"),
        (F.row_number().over(at_merchant) > 1).alias("merchant_known"),
        F.col("merchant_mean").cast("float").alias("merchant_avg"),
        mcc.alias("mcc"),
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("id") * 7919 % 1500).cast("float").alias("km_home"),
        (F.col("id") * 104729 % 1200).cast("float").alias("last_km"),
        F.lag("epoch").over(own).alias("last_epoch"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def payloads(tx: DataFrame) -> DataFrame:
    """id and body: the JSON payload of each transaction. A first transaction has an explicit null."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    merchant = F.concat(F.lit("M-"), F.col("k").cast("string"))
    last = F.when(F.col("last_epoch").isNotNull(), F.struct(iso(F.timestamp_seconds("last_epoch")).alias("timestamp"), F.col("last_km").alias("km_from_current")))
    known = F.when(F.col("merchant_known"), F.array(F.lit("M-x"), merchant, merchant)).otherwise(F.array(F.lit("M-x")))
    body = F.struct(
        F.concat(F.lit("tx-"), F.col("id").cast("string")).alias("id"),
        F.struct("amount", "installments", iso(F.col("requested_ts")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", known.alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", F.col("km_home").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )
    return tx.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def vectors(tx: DataFrame, keep: list[str], kind: str = "float", signed_minutes: bool = False) -> DataFrame:
    """keep, q0..q13 and part_key of transactions."""
    v = tx.select(*keep, *C.features(kind, signed_minutes))
    q = v.select(*keep, *(V.quantize(F.col(f"v{i}"), kind).alias(c) for i, c in enumerate(S.Q)))
    return q.withColumn("part_key", V.partition_key())


def as_references(q: DataFrame) -> DataFrame:
    return q.withColumnRenamed("id", "ref_id")


def as_queries(q: DataFrame) -> DataFrame:
    """Every row whose id is divisible by QUERY_EVERY."""
    return q.filter(F.col("id") % QUERY_EVERY == 0).withColumnRenamed("id", "query_id").drop("label")
