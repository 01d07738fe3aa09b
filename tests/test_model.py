"""Golden payloads, scalars, neighbours, index, scores."""

import gzip
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein import schemas as S
from skein import settings as options
from skein.functions import features as C
from skein.functions import scoring
from skein.functions import vectors as V
from skein.operators import knn, ranks
from skein.plans.transactions import vectors
from skein.sources import index, ingest
from skein.streaming import score as stream


def payload(amount, inst, at, avg, n24, known, mid, mcc, mavg, online, present, km, last=None, **extra):
    return {"id": "tx", "transaction": {"amount": amount, "installments": inst, "requested_at": at}, "customer": {"avg_amount": avg, "tx_count_24h": n24, "known_merchants": known}, "merchant": {"id": mid, "mcc": mcc, "avg_amount": mavg}, "terminal": {"is_online": online, "card_present": present, "km_from_home": km}, "last_transaction": last, **extra}


LEGIT = payload(41.12, 2, "2026-03-11T18:45:53Z", 82.24, 3, ["MERC-003", "MERC-016"], "MERC-016", "5411", 60.25, False, True, 29.23)
FRAUD = payload(9505.97, 10, "2026-03-14T05:15:12Z", 81.28, 20, ["MERC-008", "MERC-007", "MERC-005"], "MERC-068", "7802", 54.86, False, True, 952.27)
LAST = payload(100.0, 1, "2026-03-11T20:23:35Z", 100.0, 1, ["M"], "M", "5411", 100.0, False, True, 1.0, {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774})


def parsed(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return ingest.parse(spark.createDataFrame(rows, "id long, body string"))


def features(spark, *bodies, **options):
    return [list(r) for r in parsed(spark, *bodies).orderBy("id").select(*C.features(**options)).collect()]


def test_golden_vectors(spark):
    legit, fraud, last = features(spark, LEGIT, FRAUD, LAST)
    assert legit == pytest.approx([0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006], abs=1e-3)
    assert fraud == pytest.approx([0.9506, 0.8333, 1, 0.2174, 0.8333, -1, -1, 0.9523, 1, 0, 1, 1, 0.75, 0.0055], abs=1e-3)
    assert last[5:7] == pytest.approx([0.225694, 0.01886], abs=1e-4)


def edit(base, path, value):
    out = json.loads(json.dumps(base))
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


CASES = [
    (LEGIT, True), (edit(LEGIT, ["last_transaction"], KeyError), False), (edit(LEGIT, ["last_transaction"], {}), False), (edit(LEGIT, ["last_transaction"], {"timestamp": "2026-03-11T14:58:35Z"}), False),
    (edit(LEGIT, ["transaction", "installments"], -2), False), (edit(LEGIT, ["transaction", "installments"], 3.7), True), (edit(LEGIT, ["transaction", "installments"], "3"), False), (edit(LEGIT, ["transaction", "installments"], 4294967296), False),
    (edit(LEGIT, ["transaction", "amount"], "1.5"), False), (edit(LEGIT, ["merchant"], KeyError), False), (edit(LEGIT, ["customer", "known_merchants"], []), True), (edit(LEGIT, ["terminal", "is_online"], "yes"), False),
    (edit(LEGIT, ["transaction", "requested_at"], "yesterday"), False), (edit(LEGIT, ["transaction", "requested_at"], "2026-03-11T18:45:53.123+02:00"), True), ("{}", False), ("junk", False), ("", False), (json.dumps(LEGIT, separators=(",", ":")), True),
]


def test_valid_and_rejected_payloads(spark):
    rows = parsed(spark, *(b for b, _ in CASES)).orderBy("id").collect()
    assert [r["is_valid"] for r in rows] == [ok for _, ok in CASES]
    assert rows[5]["installments"] == 3 and rows[10]["merchant_known"] is False


def test_feature_edges(spark):
    low = edit(LEGIT, ["customer", "avg_amount"], 0)
    negative = edit(LEGIT, ["transaction", "amount"], -5)
    after = edit(LAST, ["last_transaction", "timestamp"], "2026-03-11T20:53:35Z")
    just = edit(LAST, ["last_transaction", "timestamp"], "2026-03-11T20:22:36Z")
    far = edit(LAST, ["last_transaction", "km_from_current"], 5000)
    a = features(spark, low, negative, after, just, far)
    assert a[0][2] == 1.0 and a[1][0] == 0.0 and a[2][5] == pytest.approx(30 / 1440) and a[3][5] == 0.0 and a[4][6] == 1.0
    assert features(spark, after, kind="double", signed_minutes=True)[0][5] == 0.0


def test_quantize_and_key(spark):
    cases = [(0.0, 0), (1.0, 10000), (-1.0, -10000), (0.5, 5000), (2.0, 10000), (-2.0, -10000), (0.00004, 0), (0.00005, 1), (-0.00005, -1), (float("nan"), 0)]
    for kind in ("float", "double"):
        got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double").orderBy("i").select(V.quantize(F.col("x").cast(kind), kind)).collect()
        assert [r[0] for r in got] == [q for _, q in cases]
    rows = [({}, 1), ({5: -10000}, 0), ({5: -10000, 9: 10000}, 2), ({12: 3000}, 17), ({12: 5000}, 33), ({12: 7000}, 49), ({2: 4097, 8: 2049, 10: 1, 11: 1}, 1 + 4 + 8 + 64 + 128)]
    df = spark.createDataFrame([(i, *(q.get(k, 0) for k in range(14))) for i, (q, _) in enumerate(rows)], "i int, " + ", ".join(f"{c} smallint" for c in S.Q))
    assert [r[0] for r in df.orderBy("i").select(V.partition_key()).collect()] == [k for _, k in rows]


def test_calendar_and_risk(spark):
    days = spark.createDataFrame([("2026-03-11T20:23:35Z",), ("2026-03-14T00:00:00Z",), ("2026-03-15T00:00:00Z",), ("2026-03-16T00:00:00Z",)], "s string").select(F.weekday(ingest.moment(F.col("s"))))
    assert [r[0] for r in days.collect()] == [2, 5, 6, 0]
    risks = spark.createDataFrame([("9999",), ("",), ("5411",)], "m string").select(C.mcc_risk(F.col("m"), "double"))
    assert [r[0] for r in risks.collect()] == [0.5, 0.5, 0.15]


def test_http(spark):
    def request(line, header, body):
        return f"{line}\r\nHost: a\r\n{header}\r\n\r\n{body}"

    b = json.dumps(LEGIT)
    raws = [
        (request("POST /fraud-score HTTP/1.1", f"Content-Length: {len(b)}", b), 200), (request("POST /fraud-score?x HTTP/1.1", f"CONTENT-length:\t{len(b)}", b), 200), (request("POST /fraud-scorex HTTP/1.1", f"Content-Length: {len(b)}", b), 404),
        (request("GET /ready HTTP/1.1", "A: b", ""), 200), (request("GET /fraud-score HTTP/1.1", "A: b", ""), 404), (request("BREW /ready HTTP/1.1", "A: b", ""), 400), (request("POST /fraud-score HTTP/1.1", "A: b", b), 400),
        (request("POST /fraud-score HTTP/1.1", "Content-Length: 2", "{}"), 400), (request("POST /fraud-score HTTP/1.1", f"Content-Length: {len(b) + 5}", b), None), ("POST /fr", None), (request("POST /fraud-score HTTP/1.1", "Content-Length: 5000", "x" * 5000), 413),
        (request("POST /fraud-score HTTP/1.1", f"Content-Length: {len(b):025d}", b), 200), (request("POST /fraud-score HTTP/1.1", f"Content-Length: 1{len(b):09d}", b), None), (request("POST /fraud-score HTTP/1.1", "Content-Length: " + "9" * 30, b), None),
    ]
    rows = ingest.statuses(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(raws)], "id int, raw string")).orderBy("id").collect()
    assert [r["status"] for r in rows] == [s for _, s in raws]


def as_table(spark, rows, who):
    return spark.createDataFrame([(i, *((label,) if who == "ref_id" else ()), *v) for i, label, v in rows], f"{who} long, " + ("label int, " if who == "ref_id" else "") + ", ".join(f"{c} smallint" for c in S.Q)).withColumn("part_key", V.partition_key())


def all_plans(refs, queries):
    plans = {"brute": knn.brute(refs, queries), "matrix": knn.matrix(refs, queries), "pruned": knn.pruned(refs, queries, index.bounds(refs))}
    return {k: sorted(tuple(r) for r in v.collect()) for k, v in plans.items()}


def vec(*head):
    return (*head, *[0] * (14 - len(head)))


def test_small_neighbour_cases(spark):
    one = as_table(spark, [(7, 0, vec())], "query_id")
    three = as_table(spark, [(i, 1, vec(i)) for i in range(3)], "ref_id")
    n = knn.frauds(one, knn.pruned(three, one, index.bounds(three))).first()["fraud_count"]
    assert n == 3
    tied = as_table(spark, [(i, int(i == 5), vec(100)) for i in range(6)], "ref_id")
    assert all(sum(r[4] for r in rows) == 0 and len(rows) == 5 for rows in all_plans(tied, one).values())
    far = as_table(spark, [(i, 0, vec(*[0] * 9, 3000)) for i in range(1, 6)] + [(0, 1, vec(3000))], "ref_id")  # id 0 ties in another partition
    for rows in all_plans(far, one).values():
        assert [r[2] for r in rows] == [0, 1, 2, 3, 4]
    none = three.limit(0)
    assert knn.frauds(one, knn.matrix(none, one)).first()["fraud_count"] == 0
    assert knn.frauds(one, knn.pruned(none, one, index.bounds(none))).first()["fraud_count"] == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_plans_agree(spark, seed):
    import random

    r = random.Random(seed)
    row = lambda: tuple(r.choice((-10000, -1, 0, 1, 2000, 3000, 5000, 7000, 10000)) for _ in range(14))
    refs = as_table(spark, [(i, r.randrange(2), row()) for i in range(r.choice((3, 40, 300)))], "ref_id")
    queries = as_table(spark, [(i, 0, row()) for i in range(12)], "query_id")
    plans = all_plans(refs, queries)
    assert plans["brute"] == plans["matrix"] == plans["pruned"]


def test_blocks_of_queries_and_references(spark, monkeypatch):
    import random

    r = random.Random(1)
    row = lambda: tuple(r.randrange(-10000, 10001) for _ in range(14))
    refs, queries = as_table(spark, [(i, 0, row()) for i in range(500)], "ref_id"), as_table(spark, [(i, 0, row()) for i in range(30)], "query_id")
    want = all_plans(refs, queries)["brute"]
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(knn, "MOST_BROADCAST", 8 * 15 * 7)
    assert sorted(tuple(x) for x in knn.matrix(refs, queries).collect()) == want
    assert sorted(tuple(x) for x in knn.pruned(refs, queries, index.bounds(refs)).collect()) == want
    refs = as_table(spark, [(i, 0, vec(r.randrange(-10000, 10001), r.randrange(100))) for i in range(2000)], "ref_id")
    queries = as_table(spark, [(i, 0, vec(r.randrange(-10000, 10001), 50)) for i in range(30)], "query_id")
    want = sorted(tuple(x) for x in knn.matrix(refs, queries).collect())
    boxes = index.bounds(refs)
    cut = index.cuts(refs, boxes, 64)
    cells = index.bounds(index.with_cells(refs, cut))
    assert cut.count() == boxes.filter("n > 64").count() and cells.count() > 25 and cells.agg(F.max("n")).first()[0] < 200
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    assert sorted(tuple(x) for x in knn.pruned(refs, queries, index.bounds(refs)).collect()) == want
    # a query set beyond one broadcast goes to matrix()
    assert sorted(tuple(x) for x in knn.brute(refs, queries).collect()) == want


def test_matrix_sorts_few_of_the_pairs(monkeypatch):
    import numpy as np

    r, sorts, plain = np.random.default_rng(3), [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda q, r, k: (sorts.append(len(q) * len(r)), plain(q, r, k))[1])
    q = r.integers(-10000, 10001, (300, 14)).astype(float)
    any_order = r.integers(-10000, 10001, (9000, 14)).astype(float)
    nearer = np.outer(np.linspace(1, 0, 9000), np.full(14, 10000.0)).round()  # each batch is nearer than all before
    close = q[r.integers(0, 300, 9000)] + r.integers(-1, 2, (9000, 14))  # distances of a few units beside norms of 10^9
    for refs, queries in ((any_order, q), (nearer, np.zeros((300, 14))), (np.full((9000, 14), 7.0), q), (close, q), (any_order[:3], q)):
        ids, label = r.permutation(len(refs)).astype(np.int64), r.integers(0, 2, len(refs)).astype(np.int32)
        best = knn.Nearest(queries, 5)
        for i in range(0, len(refs), 2500):
            best.add(ids[i : i + 2500], refs[i : i + 2500], label[i : i + 2500])
        at, d, rid, got = best.found()
        whole = ((queries[:, None] - refs[None]) ** 2).sum(2).astype(np.int64)
        order = np.stack([np.lexsort((ids, x))[:5] for x in whole])
        assert at.tolist() == np.repeat(np.arange(300), order.shape[1]).tolist() and rid.tolist() == ids[order].ravel().tolist()
        assert d.tolist() == np.take_along_axis(whole, order, 1).ravel().tolist() and got.tolist() == label[order].ravel().tolist()
        if refs is any_order:
            assert sum(sorts) < 0.5 * len(refs) * len(q)


def test_brute_ranks_few_of_the_pairs(spark, monkeypatch):
    import random

    r, ranked, seen = random.Random(4), knn.ranked, []
    monkeypatch.setattr(knn, "ranked", lambda found, *x, **y: (seen.append(found), ranked(found, *x, **y))[1])
    for row in (lambda: vec(*(r.randrange(-10000, 10001) for _ in range(14))), lambda: vec(5)):  # the second: all tie
        refs, queries = as_table(spark, [(i, 0, row()) for i in range(9000)], "ref_id"), as_table(spark, [(i, 0, row()) for i in range(10)], "query_id")
        want = sorted(tuple(x) for x in knn.matrix(refs, queries).collect())
        seen.clear()
        assert sorted(tuple(x) for x in knn.brute(refs, queries).collect()) == want
        assert sum(x.count() for x in seen) < 0.2 * 9000 * 10
    # more pairs than MOST_PAIRS are for matrix()
    monkeypatch.setattr(knn, "MOST_PAIRS", 9000 * 10 - 1)
    monkeypatch.setattr(knn, "matrix", lambda *x: x)
    assert isinstance(knn.brute(refs, queries), tuple) and not isinstance(knn.brute(refs, queries.filter("query_id > 0")), tuple)


def test_tallies_count_all_ties(spark, monkeypatch):
    import random
    from collections import Counter

    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    for seed in range(2):
        r = random.Random(seed)
        row = lambda: vec(*(r.choice((0, 3000)) for _ in range(9)), r.choice((0, 1)))
        refs = as_table(spark, [(i, r.randrange(2), row()) for i in range(120)], "ref_id")
        queries = as_table(spark, [(i, 0, row()) for i in range(12)], "query_id")
        rows = knn.brute(refs, queries, ties=True).collect()
        n, frauds = Counter((x["query_id"], x["d"]) for x in rows), Counter()
        for x in rows:
            frauds[x["query_id"], x["d"]] += x["label"]
        got = knn.tallies(refs, queries, index.bounds(refs)).collect()
        assert {(x["query_id"], x["d"]): (x["n"], x["frauds"]) for x in got} == {k: (v, frauds[k]) for k, v in n.items()} and max(n.values()) > 5


def test_search_modes(spark):
    refs, one = as_table(spark, [(i, 1, vec(i)) for i in range(6)], "ref_id"), as_table(spark, [(7, 0, vec())], "query_id")
    exact = sorted(map(tuple, knn.search(refs, one).collect()))
    assert exact == sorted(map(tuple, knn.search(refs, one, index.bounds(refs), "probe").collect())) and len(exact) == 5
    assert knn.search(refs, one, mode="null").count() == 0
    with pytest.raises(ValueError):
        knn.search(refs, one, mode="other")
    spark.conf.set(options.MODE, "null")
    spark.conf.set(options.RADIUS, "250")
    try:
        assert knn.search(refs, one).count() == 0 and options.early_radius(spark) == 0.25
        spark.conf.set(options.RADIUS, "much")
        assert options.early_radius(spark) == S.EARLY_RADIUS
    finally:
        spark.conf.unset(options.MODE)
        spark.conf.unset(options.RADIUS)


def test_index_round_trip_and_checks(spark, tmp_path):
    refs = as_table(spark, [(i, i % 2, vec(i, i)) for i in range(20)], "ref_id")
    index.write_index(refs, f"{tmp_path}/i")
    back, boxes = index.read_index(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, back.select(*refs.columns).collect())) == sorted(map(tuple, refs.collect()))
    assert index.stats(boxes).first().asDict() == {"n": 20, "partitions": 1, "frauds": 10}
    spark.createDataFrame([(9, 14, 10000, 20)], "version int, dim int, scale int, n bigint").write.mode("overwrite").parquet(f"{tmp_path}/i/meta")
    with pytest.raises(ValueError):
        index.read_index(spark, f"{tmp_path}/i")
    with pytest.raises(ValueError):
        index.write_index(refs.limit(0), f"{tmp_path}/empty")


def test_reference_and_test_files(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump([{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [0] * 13 + [1], "label": "legit"}], f)
    rows = index.quantized(ingest.read_references(spark, f"{tmp_path}/r.json.gz")).orderBy("ref_id").collect()
    assert [(r["ref_id"], r["label"], r["q0"], r["q13"]) for r in rows] == [(0, 1, 1000, 1000), (1, 0, 0, 10000)]
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.json").write_text(json.dumps([{"vector": [0.1 * k] * 14, "label": "fraud"}] * (k + 2), indent=1))
    assert ingest.read_references(spark, f"{tmp_path}/many").select("ref_id").distinct().count() == 9
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1.0], "label": "x"}]))
    with pytest.raises(Exception):
        ingest.read_references(spark, f"{tmp_path}/bad.json").collect()
    stats = {"total": 2, "fraud_count": 1, "fraud_rate": 0.5, "legit_count": 1, "legit_rate": 0.5, "edge_case_rate": 0.0}
    (tmp_path / "t.json").write_text(json.dumps({"stats": stats, "entries": [{"request": r, "expected_approved": a, "expected_fraud_score": s} for r, a, s in ((LEGIT, True, 0.0), (LAST, False, 0.6))]}))
    t = ingest.read_test_data(spark, f"{tmp_path}/t.json")
    assert ingest.parse(t).filter("is_valid").count() == 2 and ingest.limit_entries(t, 1).count() == 1


def test_scores(spark):
    one = spark.range(1)
    n = lambda *x: [F.lit(v).cast("bigint") for v in x]
    got = one.select(scoring.detection_score(*n(0, 998, 1, 1, 0)).alias("d"), scoring.p99_score(F.lit(10.0)).alias("p"), scoring.detection_score(*n(0, 0, 0, 0, 0)).alias("none"), scoring.detection_score(*n(0, 8, 2, 0, 0)).alias("cut"), scoring.p99_score(F.lit(2001.0)).alias("slow"), scoring.p99_score(F.lit(0.2)).alias("top"), scoring.p99_score(F.lit(0.0)).alias("zero")).first()
    assert got["d"] == pytest.approx(2188.249, abs=1e-3) and got["p"] == 2000 and got["none"] == 3000 and got["cut"] == -3000 and got["slow"] == -3000 and got["top"] == 3000 and got["zero"] == 0
    counts = spark.createDataFrame([(i,) for i in range(6)], "c long").select(scoring.approved(F.col("c")), scoring.score(F.col("c")), scoring.decision_json(F.col("c"))).collect()
    assert [r[0] for r in counts] == [True] * 3 + [False] * 3 and [r[1] for r in counts] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert counts[3][2] == '{"approved":false,"fraud_score":0.6}'


def test_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert tuple(ranks.at_shares(df, "x", {"a": 0.5, "b": 0.0, "c": 1.0}).first()) == (3.0, 1.0, 4.0)
    assert tuple(ranks.at_shares(df.limit(0), "x", {"a": 0.5}).first()) == (None,)
    many = spark.range(10_000).select((F.col("id") * 7919 % 10_000 / 2).alias("x"))
    assert tuple(ranks.at_shares(many, "x", {"a": 0.999, "b": 0.1}).first()) == (9990 / 2, 1000 / 2)


def test_stream_equals_batch(spark, tmp_path):
    refs = vectors(parsed(spark, *[edit(FRAUD, ["transaction", "amount"], 9000 + i) for i in range(4)], *[edit(LEGIT, ["transaction", "amount"], 40 + i) for i in range(6)]).withColumn("label", (F.col("id") < 4).cast("int")), ["id", "label"]).withColumnRenamed("id", "ref_id")
    sent = spark.createDataFrame([(1, json.dumps(FRAUD)), (2, json.dumps(LEGIT)), (3, "{}")], "id long, body string")
    want = {tuple(r) for r in stream.score_batch(sent, refs, index.bounds(refs)).collect()}
    assert want == {(1, 200, False, 0.8), (2, 200, True, 0.0), (3, 400, None, None)}
    sent.repartition(3).write.json(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.run(spark, f"{tmp_path}/in", (refs, index.bounds(refs)), f"{tmp_path}/out", f"{tmp_path}/cp", 1)
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "status", "approved", "fraud_score").collect()} == want


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "n int, score double")
    assert index.report_line(df).first()[0] == "n=1 score=2.5"
    index.write_report(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first()["score"] == 2.5
