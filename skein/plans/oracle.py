"""The catalogue's queries as SQL of another engine, written out independently of the plans."""

from __future__ import annotations

DIM = 14
_RISK = "CASE mcc WHEN '5411' THEN 0.15 WHEN '5812' THEN 0.30 WHEN '5912' THEN 0.20 WHEN '5944' THEN 0.45 WHEN '7801' THEN 0.80 WHEN '7802' THEN 0.75 WHEN '7995' THEN 0.85 WHEN '4511' THEN 0.35 WHEN '5311' THEN 0.25 WHEN '5999' THEN 0.50 ELSE 0.50 END"
_MCC = "CASE k % 11 WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5912' WHEN 3 THEN '5944' WHEN 4 THEN '7801' WHEN 5 THEN '7802' WHEN 6 THEN '7995' WHEN 7 THEN '4511' WHEN 8 THEN '5311' WHEN 9 THEN '5999' ELSE 'unknown' END"

TX = f"""e AS (
  SELECT event_id AS id, ts, user_id, event_type, CAST(value * 20 AS FLOAT) AS amount,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS es FROM events),
tx AS (
  SELECT id, ts, es, k, amount, k % 12 + 1 AS inst,
    CAST(avg(CAST(amount AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, id) AS FLOAT) AS cavg,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n24,
    row_number() OVER (PARTITION BY user_id, k ORDER BY ts, id) > 1 AS known,
    CAST(avg(CAST(amount AS DOUBLE)) OVER (PARTITION BY k ORDER BY ts, id) AS FLOAT) AS mavg,
    {_MCC} AS mcc, event_type IN ('click', 'view') AS online, event_type = 'purchase' AS present,
    CAST((id * 7919) % 1500 AS FLOAT) AS kmh, CAST((id * 104729) % 1200 AS FLOAT) AS kml,
    lag(es) OVER (PARTITION BY user_id ORDER BY ts, id) AS les,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM e)"""


def _features(t: str, signed: bool) -> str:
    c01 = lambda x: f"greatest(CAST(0 AS {t}), least(CAST(1 AS {t}), {x}))"
    div = lambda a, b: f"CAST(CAST({a} AS {t}) / CAST({b} AS {t}) AS {t})"
    minutes = "greatest(0, (es - les)) // 60" if signed else "abs(es - les) // 60"
    v = [
        c01(div("amount", 10000)), c01(div("inst", 12)), f"CASE WHEN cavg > 0 THEN {c01(div(div('amount', 'cavg'), 10))} ELSE CAST(1 AS {t}) END",
        div("hour(ts)", 23), div("(isodow(ts) - 1)", 6), f"CASE WHEN les IS NULL THEN CAST(-1 AS {t}) ELSE {c01(div(minutes, 1440))} END",
        f"CASE WHEN les IS NULL THEN CAST(-1 AS {t}) ELSE {c01(div('kml', 1000))} END", c01(div("kmh", 1000)), c01(div("n24", 20)),
        f"CAST(CASE WHEN online THEN 1 ELSE 0 END AS {t})", f"CAST(CASE WHEN present THEN 1 ELSE 0 END AS {t})", f"CAST(CASE WHEN known THEN 0 ELSE 1 END AS {t})",
        f"CAST({_RISK} AS {t})", c01(div("mavg", 10000)),
    ]
    return ", ".join(f"{x} AS v{i}" for i, x in enumerate(v))


def _q(x: str, t: str) -> str:
    return f"CAST(trunc({x} * CAST(10000 AS {t}) + CASE WHEN {x} >= 0 THEN CAST(0.5 AS {t}) ELSE CAST(-0.5 AS {t}) END) AS BIGINT)"


_KEY = "(CASE WHEN q5 >= 0 THEN 1 ELSE 0 END) + (CASE WHEN q9 > 0 THEN 2 ELSE 0 END) + (CASE WHEN q10 > 0 THEN 4 ELSE 0 END) + (CASE WHEN q11 > 0 THEN 8 ELSE 0 END) + (CASE WHEN q12 <= 2047 THEN 0 WHEN q12 <= 4095 THEN 16 WHEN q12 <= 6143 THEN 32 ELSE 48 END) + (CASE WHEN q2 > 4096 THEN 64 ELSE 0 END) + (CASE WHEN q8 > 2048 THEN 128 ELSE 0 END)"


def _vectors(name: str = "z", t: str = "FLOAT", signed: bool = False) -> str:
    qs = ", ".join(f"{_q(f'v{i}', t)} AS q{i}" for i in range(DIM))
    return f"{name}v AS (SELECT id, label, {_features(t, signed)} FROM tx), {name}q AS (SELECT id, label, {qs} FROM {name}v), {name} AS (SELECT *, CAST({_KEY} AS BIGINT) AS part_key FROM {name}q)"


def _near(name: str = "z", ties: bool = False) -> str:
    d = " + ".join(f"(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})" for i in range(DIM))
    rank = "rank() OVER (PARTITION BY query_id ORDER BY d)" if ties else "row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id)"
    return f"{name}d AS (SELECT a.id AS query_id, b.id AS ref_id, {d} AS d, b.label FROM {name} a, {name} b WHERE a.id % 50 = 0), {name}r AS (SELECT *, {rank} AS r FROM {name}d), {name}n AS (SELECT query_id, CAST(r AS BIGINT) AS rank, ref_id, CAST(d AS BIGINT) AS d, CAST(label AS BIGINT) AS label FROM {name}r WHERE r <= 5)"


def _count(name: str = "z") -> str:
    return f"{name}c AS (SELECT query_id, CAST(sum(label) AS BIGINT) AS n FROM {name}n GROUP BY query_id)"


_F32 = f"WITH {TX}, {_vectors()}"
_KNN = f"{_F32}, {_near()}"
_SCORE = f"{_KNN}, {_count()}"
_BOTH = f"{_SCORE}, {_vectors('y', 'DOUBLE', True)}, {_near('y')}, {_count('y')}, o AS (SELECT z.query_id, z.n AS actual, y.n AS expected FROM zc z JOIN yc y ON z.query_id = y.query_id)"
_BAD, _D, _E = "query_id % 97 = 1", "actual >= 3", "expected >= 3"
_CONF = f"{_BOTH}, c AS (SELECT count(*) FILTER (WHERE NOT ({_BAD}) AND {_D} AND {_E}) AS tp, count(*) FILTER (WHERE NOT ({_BAD}) AND NOT ({_D}) AND NOT ({_E})) AS tn, count(*) FILTER (WHERE NOT ({_BAD}) AND {_D} AND NOT ({_E})) AS fp, count(*) FILTER (WHERE NOT ({_BAD}) AND NOT ({_D}) AND {_E}) AS fn, count(*) FILTER (WHERE {_BAD}) AS errors FROM o), w AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS e FROM c)"
_DET = "CASE WHEN CAST(fp + fn + errors AS DOUBLE) / n > 0.15 THEN -3000.0 ELSE 1000.0 * log10(1.0 / greatest(CAST(e AS DOUBLE) / n, 0.001)) - 300.0 * log10(1.0 + e) END"
_SORTED = "s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)"
_AT = lambda p: f"max(CASE WHEN i = least(CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT), n - 1) THEN value END)"
_P99 = "CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000.0 * log10(1000.0 / greatest(p99, 1.0)) END"
_WIDE = lambda n: ", ".join(f"q{i}" for i in n)
_BOUNDS = ", ".join([*(f"min(q{i}) AS lo{i}" for i in range(DIM)), *(f"max(q{i}) AS hi{i}" for i in range(DIM))])
_STATUS = "CASE id % 97 WHEN 4 THEN 413 WHEN 6 THEN 200 WHEN 5 THEN 404 WHEN 7 THEN 400 WHEN 0 THEN 400 WHEN 1 THEN 400 WHEN 2 THEN 400 WHEN 3 THEN 400 WHEN 9 THEN 400 WHEN 11 THEN 400 ELSE 200 END"
_EMB = ", ".join(f"CASE WHEN isnan(embedding[{i}]) THEN 0 ELSE {_q(f'greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), embedding[{i}]))', 'FLOAT')} END AS e{i}" for i in range(1, 65))

SQL: dict[str, str] = {
    "payload_parse": f"WITH {TX} SELECT id, CAST(amount AS DOUBLE) AS amount, CAST(cavg AS DOUBLE) AS customer_avg, CAST(mavg AS DOUBLE) AS merchant_avg, CAST(kmh AS DOUBLE) AS km_home, inst AS installments, es AS epoch, n24 AS tx_count_24h, known AS merchant_known, mcc, online AS is_online, present AS card_present, les AS last_epoch, CASE WHEN les IS NOT NULL THEN CAST(kml AS DOUBLE) END AS last_km, TRUE AS is_valid FROM tx",
    "payload_status": f"SELECT event_id AS id, CAST({_STATUS.replace('id %', 'event_id %')} AS INTEGER) AS status FROM events",
    "http_route": "SELECT event_id AS id, CASE event_id % 97 WHEN 5 THEN 'not_found' WHEN 6 THEN 'ready' WHEN 7 THEN 'bad' ELSE 'score' END AS route, CASE WHEN event_id % 97 = 11 THEN NULL ELSE TRUE END AS whole_body FROM events",
    "json_prop_int": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "known_merchant": f"WITH {TX} SELECT id, known FROM tx",
    "last_tx_minutes_abs": f"WITH {TX} SELECT id, CAST(abs(es - les) // 60 AS BIGINT) AS minutes FROM tx",
    "last_tx_minutes_signed": f"WITH {TX} SELECT id, CAST((es - (les + id % 7 * 3601)) // 60 AS BIGINT) AS minutes, CASE WHEN les IS NOT NULL THEN CAST(greatest(0, es - (les + id % 7 * 3601)) // 60 AS BIGINT) END AS held FROM tx",
    "calendar_features": "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, CAST(second(ts) AS BIGINT) AS second, isodow(ts) - 1 AS weekday, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS days, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events",
    "mcc_risk_lookup": f"WITH {TX} SELECT id, mcc, CAST(round({_RISK} * 10000) AS BIGINT) AS risk FROM tx",
    "amount_features": f"{_F32} SELECT id, {_WIDE((0, 1, 2, 13))} FROM z",
    "feature_vector_f32": f"{_F32} SELECT id, {_WIDE(range(DIM))} FROM z",
    "feature_vector_f64": f"WITH {TX}, {_vectors('y', 'DOUBLE', True)} SELECT id, {_WIDE(range(DIM))} FROM y",
    "quantize_embeddings": "SELECT vec_id, array_to_string([CAST(CAST(trunc(greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), x)) * CAST(10000 AS FLOAT) + CASE WHEN x >= 0 THEN CAST(0.5 AS FLOAT) ELSE CAST(-0.5 AS FLOAT) END) AS BIGINT) AS VARCHAR) for x in embedding], ',') AS q FROM embeddings",
    "partition_key_counts": f"{_F32} SELECT part_key, count(*) AS n, CAST(sum(label) AS BIGINT) AS frauds FROM z GROUP BY part_key",
    "partition_bounds": f"{_F32} SELECT part_key, {_BOUNDS} FROM z GROUP BY part_key",
    "widest_dim": f"{_F32}, b AS (SELECT part_key, {_BOUNDS} FROM z GROUP BY part_key) SELECT part_key, CAST(CASE " + " ".join(f"WHEN hi{i} - lo{i} = greatest({', '.join(f'hi{j} - lo{j}' for j in range(DIM))}) THEN {i}" for i in range(DIM)) + " END AS BIGINT) AS widest FROM b",
    "box_lower_bound": f"{_F32}, b AS (SELECT part_key, {_BOUNDS} FROM z GROUP BY part_key) SELECT z.id AS query_id, b.part_key, CAST({' + '.join(f'greatest(lo{i} - q{i}, q{i} - hi{i}, 0) * greatest(lo{i} - q{i}, q{i} - hi{i}, 0)' for i in range(DIM))} AS BIGINT) AS bound FROM z, b WHERE z.id % 50 = 0",
    **{k: f"{_KNN} SELECT query_id, rank, ref_id, d, label FROM zn" for k in ("knn_brute", "knn_matrix", "knn_pruned")},
    "knn_radius_flag": f"{_KNN} SELECT query_id, coalesce(max(CASE WHEN rank = 5 THEN d END) <= 1960000, FALSE) AS within FROM zn GROUP BY query_id",
    "knn_tie_interval": f"{_F32}, {_near('z', True)}, m AS (SELECT *, max(d) OVER (PARTITION BY query_id) AS worst FROM zn), g AS (SELECT query_id, count(*) FILTER (WHERE d < worst) AS near, coalesce(sum(label) FILTER (WHERE d < worst), 0) AS sure, count(*) FILTER (WHERE d = worst) AS ties, coalesce(sum(label) FILTER (WHERE d = worst), 0) AS tied FROM m GROUP BY query_id) SELECT query_id, CAST(sure + greatest(0, 5 - near - (ties - tied)) AS BIGINT) AS least, CAST(sure + least(5 - near, tied) AS BIGINT) AS most FROM g",
    "fraud_score": f"{_SCORE} SELECT query_id, n AS fraud_count, CAST(n AS DOUBLE) / 5 AS fraud_score, n < 3 AS approved FROM zc",
    "fraud_decision_json": f"{_SCORE} SELECT query_id, CASE n WHEN 0 THEN '{{\"approved\":true,\"fraud_score\":0.0}}' WHEN 1 THEN '{{\"approved\":true,\"fraud_score\":0.2}}' WHEN 2 THEN '{{\"approved\":true,\"fraud_score\":0.4}}' WHEN 3 THEN '{{\"approved\":false,\"fraud_score\":0.6}}' WHEN 4 THEN '{{\"approved\":false,\"fraud_score\":0.8}}' ELSE '{{\"approved\":false,\"fraud_score\":1.0}}' END AS body FROM zc",
    "null_search": "SELECT event_id AS query_id, CAST(0 AS DOUBLE) AS fraud_score, TRUE AS approved FROM events WHERE event_id % 50 = 0",
    "search_modes": f"{_SCORE} SELECT mode, query_id, CASE WHEN mode = 'null' THEN 0 ELSE n END AS fraud_count FROM zc, (SELECT unnest(['exact', 'fast', 'probe', 'null']) AS mode) m",
    "index_report": f"{_F32} SELECT 'n=' || count(*) || ' partitions=' || count(DISTINCT part_key) || ' frauds=' || CAST(sum(label) AS BIGINT) AS line FROM z",
    "references_from_json": f"{_F32} SELECT part_key, count(*) AS n, CAST(sum(label) AS BIGINT) AS frauds, {', '.join(f'CAST(sum(q{i}) AS BIGINT) AS q{i}' for i in range(DIM))} FROM z GROUP BY part_key",
    "load_report": "WITH s AS (SELECT event_type AS phase, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT phase, max(n) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, "
    + ", ".join(f"{_AT(p)} AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))
    + " FROM s GROUP BY phase",
    "confusion_counts": f"{_CONF} SELECT tp, tn, fp, fn, errors FROM c",
    "edge_counts": f"{_BOTH} SELECT count(*) FILTER (WHERE expected = 3) AS edge_total, count(*) FILTER (WHERE expected = 3 AND NOT ({_D})) AS edge_wrong, CAST(count(*) FILTER (WHERE {_D} AND NOT ({_E})) + 3 * count(*) FILTER (WHERE NOT ({_D}) AND {_E}) AS BIGINT) AS tally_errors FROM o",
    "weighted_error": f"{_CONF} SELECT CAST(n AS BIGINT) AS n, CAST(e AS BIGINT) AS weighted_errors, CAST(fp + fn + errors AS BIGINT) AS failures, round(CAST(e AS DOUBLE) / n, 6) AS epsilon, round(CAST(fp + fn + errors AS DOUBLE) / n, 6) AS failure_rate FROM w",
    "detection_score": f"{_CONF} SELECT round({_DET}, 6) AS detection_score FROM w",
    "p99_score": f"WITH {_SORTED}, t AS (SELECT {_AT(0.99)} AS p99 FROM s) SELECT round({_P99}, 6) AS p99_score FROM t",
    "final_score": f"{_CONF}, {_SORTED}, t AS (SELECT {_AT(0.99)} AS p99 FROM s), f AS (SELECT round({_DET}, 6) AS detection_score, round({_P99}, 6) AS p99_score FROM w, t) SELECT detection_score, p99_score, round(detection_score + p99_score, 6) AS final_score FROM f",
    "latency_percentiles": f"WITH {_SORTED} SELECT {_AT(0.5)} AS p50, {_AT(0.9)} AS p90, {_AT(0.99)} AS p99, {_AT(0.999)} AS p999, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM s",
    "precision_diff_counts": f"WITH {TX}, {_vectors()}, {_vectors('y', 'DOUBLE', False)}, g AS (SELECT {' + '.join(f'(CASE WHEN z.q{i} <> y.q{i} THEN 1 ELSE 0 END)' for i in range(DIM))} AS n FROM z JOIN y ON z.id = y.id) SELECT count(*) AS vectors, CAST(sum(n) AS BIGINT) AS diff_components, count(*) FILTER (WHERE n > 0) AS diff_vectors FROM g",
    "dataset_stats": f"{_SCORE} SELECT count(*) AS total, count(*) FILTER (WHERE n >= 3) AS fraud_count, round(CAST(count(*) FILTER (WHERE n >= 3) AS DOUBLE) / count(*), 6) AS fraud_rate, count(*) FILTER (WHERE n < 3) AS legit_count, round(CAST(count(*) FILTER (WHERE n < 3) AS DOUBLE) / count(*), 6) AS legit_rate, round(CAST(count(*) FILTER (WHERE n = 3) AS DOUBLE) / count(*), 6) AS edge_case_rate FROM zc",
    "embedding_knn_vote": f"WITH m AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, {_EMB} FROM embeddings), d AS (SELECT a.id AS query_id, b.id AS ref_id, b.label, {' + '.join(f'(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})' for i in range(1, 65))} AS d FROM m a, m b WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS r FROM d) SELECT query_id, CAST(sum(label) AS BIGINT) AS votes FROM r WHERE r <= 5 GROUP BY query_id",
    "stream_score": f"{_SCORE} SELECT query_id, CAST(CASE WHEN query_id % 350 = 0 THEN 400 ELSE 200 END AS BIGINT) AS status, CASE WHEN query_id % 350 <> 0 THEN CAST(n AS DOUBLE) / 5 END AS fraud_score, CASE WHEN query_id % 350 <> 0 THEN n < 3 END AS approved FROM zc",
}
