"""Near-duplicate vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from skein.llm import neighbours, queries

SF = "/root/testdata/sf0.01"


def brute(vectors, limit=0.95):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= limit
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def got(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def test_op4_equals_all_pairs(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = queries.op4_embedding_near_dedup(spark, SF).collect()
    want, have = brute(vectors), got(rows)
    assert have.keys() == want.keys()
    links = sum(n for n, _ in want.values())
    assert all(have[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in have.values()) >= 0.98 * links
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in rows)


def test_saturated_lists_are_enlarged_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(3)
    vectors = {}
    for c in range(3):
        centre = rng.normal(size=32)
        for i in range(170):
            vectors[1000 * c + i] = (centre + rng.normal(size=32) * 0.15).tolist()
    for i in range(300):
        vectors[5000 + i] = rng.normal(size=32).tolist()
    for i in range(40):
        vectors[8000 + i] = vectors[0]
    rows = neighbours.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    assert got(rows) == brute(vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], None), (5, [nan, 1.0], ""), (6, [inf, 0.0], "x"), (7, [None, 1.0], "x"), (8, [], "x"), (9, [1.0, 0.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (10, [1e300, 1e290], "x"), (11, [0.0, 1e-300], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")
    out = neighbours.near_vectors(df).collect()
    assert len(out) == len(rows)
    have = got(out)
    assert have[1] == (2, 1) and have[2] == (2, 1) and have[10] == (2, 1)
    assert all(have[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and have[None] == (0, None)
    none = neighbours.near_vectors(df.limit(0))
    assert none.count() == 0 and none.audited == (None, 0)


def test_repeated_ids_with_other_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (1, c), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (4, [1.0, 0.02, 0.0]), (5, c), (6, [1.0, 1.0, 1.0]), (1, a)]
    out = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows) and got(out) == {1: (2, 1), 2: (2, 1), 3: (1, 1), 4: (2, 1), 5: (1, 1), 6: (0, 6)}


def test_links_between_saturated_groups(spark):
    """Each list is full of links to its own group; the links to the other group are in none of them."""
    rng = np.random.default_rng(5)
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    centres = [a, np.cos(0.266) * a + np.sin(0.266) * b, -a]
    vectors = {1000 * c + i: (centres[c] + rng.normal(size=64) * 0.001).tolist() for c in range(2) for i in range(100)}
    vectors |= {5000 + i: (centres[2] + rng.normal(size=64) * 0.001).tolist() for i in range(1500)}  # so many links that the others are less than a hundredth
    want = brute(vectors)
    assert want[0] == (199, 0) and want[1099] == (199, 0)
    assert got(neighbours.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()) == want


def test_search_that_finds_too_little_is_made_exact(spark, monkeypatch):
    """No list and no round finds a link: all blocks are compared."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "_nearest", lambda edges, k: edges.withColumn("r", F.lit(1)).filter("sim > 2"))
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=16).tolist() for i in range(100)}
    vectors |= {200 + i: (np.array(vectors[i]) * 1.5 + 0.01).tolist() for i in range(20)}
    rows = neighbours.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), rounds=1).collect()
    assert got(rows) == brute(vectors)


def planted(seed=9, dims=48):
    """Thousands of pairs near the limit, families of three to forty, one of 400, and vectors alone."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dims) for _ in range(1500)]
    near = lambda v, spread: v + rng.normal(size=dims) * np.linalg.norm(v) / np.sqrt(dims) * spread
    for _ in range(1500):
        v = rng.normal(size=dims)
        x += [v, near(v, 0.3)]
    for size in [3, 4, 6, 10, 25, 40] * 8 + [400]:
        v = rng.normal(size=dims)
        x += [near(v, 0.2) for _ in range(size)]
    order = rng.permutation(len(x))
    return {i: x[j].tolist() for i, j in enumerate(order.tolist())}


def test_recall_of_planted_links(spark):
    vectors = planted()
    want = brute(vectors)
    out = neighbours.near_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    have = got(out.collect())
    assert out.audited[0] >= neighbours.RECALL and out.audited[1] > 100
    links = sum(n for n, _ in want.values())
    assert links > 80_000 and all(have[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in have.values()) >= 0.98 * links
    # by vector, so that the large family does not stand for the pairs
    linked = [i for i in want if want[i][0]]
    assert sum(have[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_descent_finds_what_leaves_miss(spark):
    vectors = planted()
    rows = neighbours._vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    reps = rows.select("id", "dim", "x").withColumn("component", F.col("id")).persist()
    n = len(vectors)
    graph = neighbours._nearest(neighbours._leaves(reps, n, range(2)), 8).persist()
    after = neighbours._nearest(graph.select("u", "v", "sim").union(neighbours._descend(graph, reps, n, 8)), 8)
    links = lambda g: g.filter("sim >= 0.95").count()
    assert links(after) > 1.1 * links(graph)
