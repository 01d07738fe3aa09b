"""Near-duplicates against all pairs."""

import random

import pytest

from skein.llm import graph, minhash, queries

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"


def brute(texts, k, percent):
    """doc_id to (set size, component)."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    ra, rb = root(a), root(b)
                    up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def hold(rows, want):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows)


def test_op1_equals_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    hold(queries.op1_minhash_near_dedup(spark, SF).collect(), brute(texts, 3, 85))


@pytest.fixture
def family():
    """One large family of near copies, many of which are near to few others, and exact copies."""
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(260, 300):
        texts[i] = texts[i - 260]
    texts |= {400: None, 401: "", 402: "one", 403: "ONE", 404: "two words"}
    return texts


def test_blocks_lose_no_link(spark, family, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40)
    monkeypatch.setattr(minhash, "PIVOTS", 6)
    docs = spark.createDataFrame(list(family.items()), "doc_id long, text string")
    hold(minhash.near_duplicates(docs, k=3, percent=85, bands=32, rows=8).collect(), brute(family, 3, 85))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[None]["kept"]
    assert got[7]["component_id"] == 6 and not got[7]["kept"]
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.collect()} == {*range(len(ODD_TEXTS)), None} - {7}


def test_sketch_estimates_high_similarity():
    by = minhash.multipliers(256)
    a = minhash.shingles(" ".join(f"a{i}" for i in range(500)).encode(), 3)
    b = minhash.shingles(" ".join(f"a{i}" if i != 250 else "q" for i in range(500)).encode(), 3)
    s, t = (int.from_bytes(minhash.odd_sketch(minhash.sample(x, by)), "little") for x in (a, b))
    assert (s ^ t).bit_count() <= minhash.sketch_limit(0.95, 256)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and 200 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_very_long_texts(spark, monkeypatch):
    """Texts of more than a megabyte: blocks and pivots are bounded in bytes."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2 << 20)
    monkeypatch.setattr(minhash, "PIVOT_BYTES", 1 << 20)
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(160_000)]
    texts = {i: " ".join(w if r.random() > 0.004 * i else f"x{i}" for w in base) for i in range(5)}
    texts[9] = " ".join(reversed(base))
    assert min(map(len, texts.values())) > 1 << 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    hold(minhash.near_duplicates(docs, k=3, percent=85, bands=32, rows=8).collect(), brute(texts, 3, 85))
