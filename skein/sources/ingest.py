"""Payload text to transactions, with rejected rows kept and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas as S


def whole_number(x: Column) -> Column:
    """A counter: cut to a whole number; negative, too large for 32 bits, or not a number is null."""
    return F.when((x >= 0) & (x < 4294967296.0), F.floor(x).cast("bigint"))


def moment(text: Column) -> Column:
    """The first 19 characters as a moment in UTC; null if they are not one."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def parse(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with the columns of a transaction and is_valid. A payload misses its last transaction only by an explicit null."""
    p = F.from_json(F.col(body), S.PAYLOAD)
    keyed = rows.withColumn("_p", p).withColumn("_has_last", F.coalesce(F.array_contains(F.json_object_keys(F.col(body)), "last_transaction"), F.lit(False)))
    explicit = F.trim(F.get_json_object(F.col(body), "$.last_transaction"))
    out = keyed.select(
        *rows.columns,
        F.col("_p.transaction.amount").alias("amount"),
        whole_number(F.col("_p.transaction.installments")).alias("installments"),
        moment(F.col("_p.transaction.requested_at")).alias("requested_ts"),
        F.col("_p.customer.avg_amount").alias("customer_avg"),
        whole_number(F.col("_p.customer.tx_count_24h")).alias("tx_count_24h"),
        F.array_contains(F.col("_p.customer.known_merchants"), F.col("_p.merchant.id")).alias("merchant_known"),
        F.col("_p.merchant.mcc").alias("mcc"),
        F.col("_p.merchant.avg_amount").alias("merchant_avg"),
        F.col("_p.terminal.is_online").alias("is_online"),
        F.col("_p.terminal.card_present").alias("card_present"),
        F.col("_p.terminal.km_from_home").alias("km_home"),
        F.unix_timestamp(moment(F.col("_p.last_transaction.timestamp"))).alias("last_epoch"),
        F.col("_p.last_transaction.km_from_current").alias("last_km"),
        F.col("_has_last"),
        (explicit.isNotNull() & (explicit != "null")).alias("_filled"),
    ).withColumn("epoch", F.unix_timestamp("requested_ts"))
    needed = ("amount", "installments", "requested_ts", "customer_avg", "tx_count_24h", "merchant_known", "mcc", "merchant_avg", "is_online", "card_present", "km_home")
    there = F.col("_has_last")
    for c in needed:
        there = there & F.col(c).isNotNull()
    last = ~F.col("_filled") | (F.col("last_epoch").isNotNull() & F.col("last_km").isNotNull())
    return out.withColumn("is_valid", F.coalesce(there & last, F.lit(False))).drop("_has_last", "_filled")


def route(raw: Column) -> Column:
    """score, ready, not_found, bad or wait, from the text of a request."""
    target = lambda method, path: raw.startswith(f"{method} {path} ") | raw.startswith(f"{method} {path}?")
    known = raw.rlike("^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ")
    complete = (F.octet_length(raw) >= 16) & (F.instr(raw, "\r\n\r\n") > 0)
    return F.when(~complete, "wait").when(target("POST", "/fraud-score"), "score").when(target("GET", "/ready"), "ready").when(known, "not_found").otherwise("bad")


def content_length(raw: Column) -> Column:
    """Digits of the Content-Length line of the header, in any case; null if there is none. More than 18 digits are the largest number."""
    digits = F.regexp_replace(F.regexp_extract(F.substring_index(raw, "\r\n\r\n", 1), r"(?i)\r\ncontent-length:[ \t]*([0-9]+)", 1), "^0+(?=[0-9])", "")
    return F.when(digits == "", None).when(F.length(digits) > 18, F.lit((1 << 63) - 1)).otherwise(F.nullif(F.substring(digits, 1, 18), F.lit("")).cast("bigint"))


def body(raw: Column) -> Column:
    """What follows the header, as long as Content-Length says."""
    at = F.instr(raw, "\r\n\r\n")
    return F.substring(raw, at + 4, F.least(F.coalesce(content_length(raw), F.lit(0)), F.lit((1 << 31) - 1)).cast("int"))


def statuses(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with the parsed columns and an HTTP status: 200, 400, 404, 413, or null while a request is incomplete."""
    to = rows.withColumn("_route", route(F.col(raw))).withColumn("_body", F.when(F.col("_route") == "score", body(F.col(raw))))
    parsed = parse(to, "_body")
    length = content_length(F.col(raw))
    short = (F.col("_route") == "score") & (F.octet_length("_body") < length)
    status = (
        F.when(F.octet_length(raw) > S.MAX_REQUEST_BYTES, 413)
        .when((F.col("_route") == "wait") | F.coalesce(short, F.lit(False)), F.lit(None).cast("int"))
        .when(F.col("_route") == "ready", 200)
        .when(F.col("_route") == "not_found", 404)
        .when(F.col("_route") == "bad", 400)
        .otherwise(F.when(length.isNotNull() & F.col("is_valid"), 200).otherwise(400))
    )
    return parsed.withColumn("status", status).drop("_route", "_body")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """References from files of one (gzipped) JSON array each: ref_id, vector, label 0/1. Any bad entry fails the load.

    Arrays are read entry by entry; an array can't be split, so a file is one task. ref_id is the place
    in the file if there is one file; over several, ids ascend in each file and no two are equal.
    """
    rows = spark.read.schema(S.REFERENCE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("ref_id", F.monotonically_increasing_id())
    checked = F.when(F.size("vector") == S.DIM, F.col("vector")).otherwise(F.raise_error(F.lit(f"a reference needs {S.DIM} numbers")))
    return rows.select("ref_id", checked.alias("vector"), F.when(F.col("label") == S.FRAUD, 1).otherwise(0).alias("label"))


def read_test_data(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an evaluation file: entry_id, request (JSON text), expected_approved, expected_fraud_score."""
    whole = spark.read.schema(S.TEST_DATA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = whole.select(F.posexplode("entries").alias("entry_id", "e"))
    return rows.select(F.col("entry_id").cast("bigint").alias("entry_id"), F.to_json("e.request", {"ignoreNullFields": "false"}).alias("body"), "e.expected_approved", "e.expected_fraud_score")


def limit_entries(entries: DataFrame, n: int) -> DataFrame:
    """The first n entries of an evaluation file."""
    return entries.filter(F.col("entry_id") < n)
