"""The queries over whole tables: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas as S
from skein import settings
from skein.functions import features as C
from skein.functions import scoring
from skein.functions import vectors as V
from skein.operators import knn, ranks
from skein.plans.transactions import as_queries, as_references, payloads, read, transactions, vectors
from skein.sources import index, ingest
from skein.store import shared, stored
from skein.streaming import score as stream

Query = Callable[[SparkSession, str], DataFrame]
LO, HI = [f"lo{i}" for i in range(S.DIM)], [f"hi{i}" for i in range(S.DIM)]


def quantized(spark: SparkSession, d: str, kind: str = "float", signed: bool = False) -> DataFrame:
    return vectors(transactions(spark, d), ["id", "label"], kind, signed)


def sides(spark: SparkSession, d: str, kind: str = "float", signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """References (all rows) and queries (ids divisible by 50), from one stored table: the histories' windows run once."""
    q = stored(quantized(spark, d, kind, signed), "vectors")
    return as_references(q), as_queries(q)


def found(spark: SparkSession, d: str, kind: str = "float", signed: bool = False) -> tuple[DataFrame, DataFrame]:
    refs, queries = sides(spark, d, kind, signed)
    return queries, knn.pruned(refs, queries, index.bounds(refs))


def payload_parse(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.parse(payloads(transactions(spark, d)))
    as_double = [F.col(c).cast("double").alias(c) for c in ("amount", "customer_avg", "merchant_avg", "km_home")]
    last_km = F.when(F.col("last_epoch").isNotNull(), F.col("last_km").cast("double")).alias("last_km")
    return p.select("id", *as_double, "installments", "epoch", "tx_count_24h", "merchant_known", "mcc", "is_online", "card_present", "last_epoch", last_km, "is_valid")


def raw_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each payload; some kinds, by id, are broken in one way each."""
    p, kind = payloads(transactions(spark, d)), F.col("id") % 97
    last = r'"last_transaction":(?:null|\{[^}]*\})'
    fix = lambda pattern, to: F.regexp_replace("body", pattern, to)
    body = (
        F.when(kind == 0, fix("," + last, ""))
        .when(kind == 1, fix(r'"installments":\d+', '"installments":-2'))
        .when(kind == 2, fix(r'"amount":([0-9.E]+)', '"amount":"\\$1"').cast("string"))
        .when(kind == 3, fix(r'"requested_at":"[^"]*"', '"requested_at":"yesterday"'))
        .when(kind == 4, F.concat(F.lit("{"), F.lit('"pad":"'), F.repeat(F.lit("x"), 5000), F.lit('",'), F.expr("substring(body, 2)")))
        .when(kind == 8, fix(r'"installments":\d+', '"installments":3.7'))
        .when(kind == 9, fix(last, '"last_transaction":{}'))
        .when(kind == 10, fix(last, '"last_transaction":null'))
        .otherwise(F.col("body"))
    )
    line = F.when(kind == 5, "POST /other HTTP/1.1").when(kind == 6, "GET /ready?x=1 HTTP/1.1").when(kind == 7, "BREW /fraud-score HTTP/1.1").otherwise("POST /fraud-score HTTP/1.1")
    length = F.when(kind == 11, F.lit("")).otherwise(F.concat(F.lit("\r\ncontent-LENGTH: "), F.octet_length("b").cast("string")))
    return p.withColumn("b", body).select("id", F.concat(line, F.lit("\r\nHost: x"), length, F.lit("\r\n\r\n"), "b").alias("raw"))


def payload_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.statuses(raw_requests(spark, d)).select("id", "status")


def http_route(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return raw_requests(spark, d).select("id", ingest.route(raw).alias("route"), (F.octet_length(ingest.body(raw)) == ingest.content_length(raw)).alias("whole_body"))


def json_prop_int(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k double")
    return read(spark, d, "events").select("event_id", ingest.whole_number(p["k"]).alias("k"))


def known_merchant(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.parse(payloads(transactions(spark, d)))
    return p.select("id", F.col("merchant_known").alias("known"))


def last_tx_minutes_abs(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select("id", C.minutes_since(F.col("epoch"), F.col("last_epoch"), False).alias("minutes"))


def last_tx_minutes_signed(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    later = F.col("last_epoch") + F.col("id") % 7 * 3601  # some of the last transactions lie in the future
    return t.select("id", C.minutes_signed(F.col("epoch"), later).alias("minutes"), F.when(later.isNotNull(), C.minutes_since(F.col("epoch"), later, True)).alias("held"))


def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday}
    return read(spark, d, "events").select("event_id", *(f(ts).cast("bigint").alias(n) for n, f in part.items()), F.unix_date(F.to_date(ts)).cast("bigint").alias("days"), F.unix_timestamp(ts).alias("epoch"))


def mcc_risk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary as a dimension table of ten rows, joined from the left with a default."""
    dim = spark.createDataFrame([(k, round(v * S.SCALE)) for k, v in S.MCC_RISK.items()], "mcc string, risk int")
    t = transactions(spark, d).select("id", "mcc").join(F.broadcast(dim), "mcc", "left")
    return t.select("id", "mcc", F.coalesce("risk", F.lit(round(S.MCC_DEFAULT * S.SCALE))).cast("bigint").alias("risk"))


def _wide(q: DataFrame, columns: list[str]) -> DataFrame:
    return q.select("id", *(F.col(c).cast("bigint").alias(c) for c in columns))


def amount_features(spark: SparkSession, d: str) -> DataFrame:
    return _wide(quantized(spark, d), ["q0", "q1", "q2", "q13"])


def feature_vector_f32(spark: SparkSession, d: str) -> DataFrame:
    return _wide(quantized(spark, d), S.Q)


def feature_vector_f64(spark: SparkSession, d: str) -> DataFrame:
    return _wide(quantized(spark, d, "double", True), S.Q)


def quantize_embeddings(spark: SparkSession, d: str) -> DataFrame:
    q = V.quantize_array(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(q, lambda x: x.cast("string")), ",").alias("q"))


def partition_key_counts(spark: SparkSession, d: str) -> DataFrame:
    q = quantized(spark, d)
    return q.groupBy(F.col("part_key").cast("bigint").alias("part_key")).agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("frauds"))


def partition_bounds(spark: SparkSession, d: str) -> DataFrame:
    return index.bounds(quantized(spark, d)).select(*(F.col(c).cast("bigint").alias(c) for c in ("part_key", *LO, *HI)))


def widest_dim(spark: SparkSession, d: str) -> DataFrame:
    b = index.bounds(quantized(spark, d))
    return b.select(F.col("part_key").cast("bigint").alias("part_key"), V.widest([F.col(c) for c in LO], [F.col(c) for c in HI]).cast("bigint").alias("widest"))


def box_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    refs, queries = sides(spark, d)
    boxes = index.bounds(refs).withColumnRenamed("part_key", "box")
    bound = V.box_bound(*([F.col(c) for c in x] for x in (S.Q, LO, HI)))
    return queries.crossJoin(F.broadcast(boxes)).select("query_id", F.col("box").cast("bigint").alias("part_key"), bound.alias("bound"))


def _neighbours(f: DataFrame) -> DataFrame:
    return f.select("query_id", F.col("rank").cast("bigint").alias("rank"), "ref_id", "d", F.col("label").cast("bigint").alias("label"))


def knn_brute(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(knn.brute(*sides(spark, d)))


def knn_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(knn.matrix(*sides(spark, d)))


def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(found(spark, d)[1])


def knn_radius_flag(spark: SparkSession, d: str) -> DataFrame:
    f = found(spark, d)[1]
    return f.groupBy("query_id").agg(F.max(F.when(F.col("rank") == S.NEIGHBOURS, F.col("d"))).alias("d5")).select("query_id", F.coalesce(F.col("d5") <= V.radius_limit(settings.early_radius(spark)), F.lit(False)).alias("within"))


def knn_tie_interval(spark: SparkSession, d: str) -> DataFrame:
    """The least and most frauds that any order of equally distant references could give."""
    refs, queries = sides(spark, d)
    f = knn.tallies(refs, queries, index.bounds(refs))
    tied = F.col("upto") >= S.NEIGHBOURS  # at the last distance; a set of fewer references has none
    a = f.groupBy("query_id").agg(*(F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(x) for x, w, c in (("near", ~tied, "n"), ("sure", ~tied, "frauds"), ("ties", tied, "n"), ("tied", tied, "frauds"))))
    room = F.lit(S.NEIGHBOURS) - F.col("near")
    least = F.col("sure") + F.greatest(F.lit(0), room - (F.col("ties") - F.col("tied"))) * (F.col("ties") > 0).cast("int")
    return a.select("query_id", least.cast("bigint").alias("least"), (F.col("sure") + F.least(room, F.col("tied"))).cast("bigint").alias("most"))


def fraud_score(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("fraud_count")
    return knn.frauds(*found(spark, d)).select("query_id", "fraud_count", scoring.score(n).alias("fraud_score"), scoring.approved(n).alias("approved"))


def fraud_decision_json(spark: SparkSession, d: str) -> DataFrame:
    return knn.frauds(*found(spark, d)).select("query_id", scoring.decision_json(F.col("fraud_count")).alias("body"))


def search_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each search mode by its name: what it counts for each query."""
    refs, queries = sides(spark, d)
    boxes = stored(index.bounds(refs), "boxes")
    out = None
    for mode in knn.MODES:
        counts = knn.frauds(queries, knn.search(refs, queries, boxes, mode)).select(F.lit(mode).alias("mode"), "query_id", "fraud_count")
        out = counts if out is None else out.union(counts)
    return out


def index_report(spark: SparkSession, d: str) -> DataFrame:
    """What the loaded index reports, in one line."""
    path = shared(spark, "index")
    index.write_index(as_references(quantized(spark, d)), path)
    return index.report_line(index.stats(index.read_index(spark, path)[1]))


def references_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Reference files written as JSON arrays, then loaded as those are: how many, how many frauds, and sums of quantized features by partition."""
    path = shared(spark, "references")
    v = transactions(spark, d).select("id", F.when(F.col("label") == 1, S.FRAUD).otherwise("legit").alias("label"), F.array(*C.features()).alias("vector"))
    # arrays of ENTRIES at most: one file each
    files = v.groupBy(F.floor(F.col("id") / ENTRIES).alias("file")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "vector", "label")))).alias("value"))
    files.write.partitionBy("file").option("compression", "gzip").text(path)
    refs = index.quantized(ingest.read_references(spark, path))
    return refs.groupBy(F.col("part_key").cast("bigint").alias("part_key")).agg(F.count_distinct("ref_id").alias("n"), F.sum("label").cast("bigint").alias("frauds"), *(F.sum(c).cast("bigint").alias(c) for c in S.Q))


def null_search(spark: SparkSession, d: str) -> DataFrame:
    """The search mode that finds nothing: all are approved."""
    queries = as_queries(transactions(spark, d).select("id"))
    n = F.col("fraud_count")
    return knn.frauds(queries, knn.search(queries, queries, mode="null")).select("query_id", scoring.score(n).alias("fraud_score"), scoring.approved(n).alias("approved"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """query_id, expected (double precision, signed minutes) and actual (single precision, absolute) counts."""
    actual = knn.frauds(*found(spark, d)).withColumnRenamed("fraud_count", "actual")
    expected = knn.frauds(*found(spark, d, "double", True)).withColumnRenamed("fraud_count", "expected")
    return actual.join(expected, "query_id")


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("query_id") % 97 == 1  # requests that break in payload_status, counted as errors
    return outcomes(spark, d).agg(*scoring.confusion(scoring.approved(F.col("expected")), scoring.approved(F.col("actual")), failed))


def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d)


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d)
    on_edge = scoring.edge(scoring.score(F.col("expected")))
    wrong = scoring.approved(F.col("expected")) != scoring.approved(F.col("actual"))
    fp = F.count_if(scoring.approved(F.col("expected")) & ~scoring.approved(F.col("actual")))
    fn = F.count_if(~scoring.approved(F.col("expected")) & scoring.approved(F.col("actual")))
    return o.agg(F.count_if(on_edge).alias("edge_total"), F.count_if(on_edge & wrong).alias("edge_wrong"), (S.FP_WEIGHT * fp + S.FN_WEIGHT * fn).cast("bigint").alias("tally_errors"))


_COUNTS = ["tp", "tn", "fp", "fn", "errors"]


def weighted_error(spark: SparkSession, d: str) -> DataFrame:
    c = _confusion(spark, d).select(*scoring.error_rates(*(F.col(x) for x in _COUNTS)))
    return c.select(*(F.col(x).cast("bigint").alias(x) for x in ("n", "weighted_errors", "failures")), *(F.round(x, 6).alias(x) for x in ("epsilon", "failure_rate")))


def detection_score(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d).select(F.round(scoring.detection_score(*(F.col(x) for x in _COUNTS)), 6).alias("detection_score"))


#: Entries of one reference file.
ENTRIES = 50_000
#: The phases of a load report, and what is told of each.
PHASES = ("view", "click", "purchase", "signup", "error")
PHASE_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return ranks.at_shares(read(spark, d, "events"), "value", PERCENTILES)


def p99_score(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d).select(F.round(scoring.p99_score(F.col("p99")), 6).alias("p99_score"))


def final_score(spark: SparkSession, d: str) -> DataFrame:
    both = detection_score(spark, d).crossJoin(F.broadcast(p99_score(spark, d)))  # one row each
    return both.select("detection_score", "p99_score", F.round(F.col("detection_score") + F.col("p99_score"), 6).alias("final_score"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    whole = read(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return _latency(spark, d).crossJoin(F.broadcast(whole))  # one row each


def load_report(spark: SparkSession, d: str) -> DataFrame:
    """For each phase: requests, least, mean, most, and the values at exact ranks."""
    e = read(spark, d, "events")
    out = None
    for phase in PHASES:  # a fixed list
        mine = e.filter(F.col("event_type") == phase)
        whole = mine.agg(F.lit(phase).alias("phase"), F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
        one = whole.crossJoin(F.broadcast(ranks.at_shares(mine, "value", PHASE_PERCENTILES)))  # one row each
        out = one if out is None else out.union(one)
    return out


def precision_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    tx = transactions(spark, d)
    q = {k: [V.quantize(F.col(f"{k}{i}"), k).cast("int") for i in range(S.DIM)] for k in ("float", "double")}
    v = tx.select("id", *(x.alias(f"{k}{i}") for k in ("float", "double") for i, x in enumerate(C.features(k))))
    diffs = [F.when(a != b, 1).otherwise(0) for a, b in zip(q["float"], q["double"], strict=True)]
    n = v.select(sum(diffs[1:], diffs[0]).alias("n"))
    return n.agg(F.count("*").alias("vectors"), F.sum("n").cast("bigint").alias("diff_components"), F.count_if(F.col("n") > 0).alias("diff_vectors"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    c = knn.frauds(*found(spark, d))
    total, fraud = F.count("*"), F.count_if(~scoring.approved(F.col("fraud_count")))
    edge = F.count_if(scoring.edge(scoring.score(F.col("fraud_count"))))
    rate = lambda x: F.round(x.cast("double") / total.cast("double"), 6)
    return c.agg(total.alias("total"), fraud.alias("fraud_count"), rate(fraud).alias("fraud_rate"), (total - fraud).alias("legit_count"), rate(total - fraud).alias("legit_rate"), rate(edge).alias("edge_case_rate"))


def embedding_knn_vote(spark: SparkSession, d: str) -> DataFrame:
    """The same search over 64 dimensions; label 0 against the rest."""
    columns = [f"e{i}" for i in range(64)]
    q = V.quantize_array(F.col("embedding"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1).otherwise(0).alias("label"), q.alias("q"))
    e = e.select("id", "label", *(F.col("q")[i].alias(c) for i, c in enumerate(columns)))
    queries = as_queries(e)
    return knn.frauds(queries, knn.matrix(as_references(e), queries, columns=columns)).select("query_id", F.col("fraud_count").alias("votes"))


def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Payload files through the stream, against a stored index. Each seventh payload lacks its last transaction and is rejected."""
    base = shared(spark, "stream")
    tx = transactions(spark, d)
    index.write_index(as_references(quantized(spark, d)), f"{base}/index")
    broken = F.regexp_replace("body", r',"last_transaction":(?:null|\{[^}]*\})', "")
    sent = payloads(tx).filter(F.col("id") % 50 == 0).withColumn("body", F.when(F.col("id") % 350 == 0, broken).otherwise(F.col("body")))
    sent.repartition(4).write.json(f"{base}/in")
    stream.run(spark, f"{base}/in", index.read_index(spark, f"{base}/index"), f"{base}/out", f"{base}/checkpoint", files_per_batch=2)
    return spark.read.parquet(f"{base}/out").select(F.col("id").alias("query_id"), F.col("status").cast("bigint").alias("status"), "fraud_score", "approved")


ALL: tuple[Query, ...] = (
    payload_parse, payload_status, http_route, json_prop_int, known_merchant, last_tx_minutes_abs, last_tx_minutes_signed, calendar_features, mcc_risk_lookup,
    amount_features, feature_vector_f32, feature_vector_f64, quantize_embeddings, partition_key_counts, partition_bounds, widest_dim, box_lower_bound,
    knn_brute, knn_matrix, knn_pruned, knn_radius_flag, knn_tie_interval, fraud_score, fraud_decision_json, null_search, search_modes, index_report, references_from_json, load_report, confusion_counts, edge_counts,
    weighted_error, detection_score, p99_score, final_score, latency_percentiles, precision_diff_counts, dataset_stats, embedding_knn_vote, stream_score,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}
