"""The pipeline against its stages worked out by hand."""

from collections import defaultdict

import pytest

import corpus_pipeline
from skein.llm import common, langid, secrets

from .test_minhash import brute as near
from .test_quality import brute as quality
from .test_spans import secret

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if quality(r["text"])[-1]}
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == set(kept) and first.columns == docs.columns

    second = corpus_pipeline.language_id(spark, first, SF)
    model = langid.fit_language_model(first.filter(~langid.held_out()))
    kept = {i: t for i, t in kept.items() if model.predict(t.encode())[2]}
    assert {r["doc_id"] for r in second.collect()} == set(kept) and second.columns == docs.columns

    third = corpus_pipeline.minhash_near_dedup(spark, second, SF)
    kept = {i: kept[i] for i, (_, c) in near(kept, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in third.collect()} == set(kept) and third.columns == docs.columns

    fourth = corpus_pipeline.secret_scan(spark, third, SF)
    assert fourth.columns == docs.columns
    for r in fourth.collect():
        text, at, out = kept[r["doc_id"]], 0, ""
        for _, s, e in secret(text):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r["text"] == out + text[at:]

    rows = corpus_pipeline.best_fit_packing(spark, fourth, SF).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows} == set(kept) and max(by.values()) <= 4096


def test_run_on_odd_tables(spark, odd_docs, tmp_path):
    """Empty, null ids, repeated rows, names that clash with the stages' own, and a text of more than a megabyte."""
    columns = ("doc_id", "text", "lang", "source", "n_chars", "quality", "pieces", "blob", "language", "component_id", "gone", "sequence_id")
    text = lambda i, n: " ".join("".join(chr(97 + (i * 7919 + k * (j + 3) * 31 + j * j) % 26) for j in range(4 + k % 5)) + f"{i}x{k}" for k in range(8 * n))
    rows = [(i, text(i, 20), "en", "s", 1, "q", 1.0, "b", "x", 5, 6, 7) for i in range(30)]
    rows += [rows[0], (None, text(40, 20), "en", None, None, None, None, None, None, None, None, None), (31, None, None, None, None, None, None, None, None, None, None, None), (32, text(50, 40_000), "en", "s", 1, "q", 1.0, "b", "x", 5, 6, 7), (33, f"{text(51, 20)} password=abcdefghijklmnop", "en", "s", 1, "q", 1.0, "b", "x", 5, 6, 7), (34, "", "en", "s", 1, "q", 1.0, "b", "x", 5, 6, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, pieces double, blob string, language string, component_id long, gone long, sequence_id long"
    for name, some in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        assert tuple(docs.columns) == columns
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert tuple(docs.columns) == columns
        left = docs.collect()
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left} == ({*range(30), None, 32, 33} if some else set())
        assert all("password=" not in r["text"] for r in left)


def test_tables_of_a_stage_are_removed(spark, tmp_path):
    import os

    at = common.shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(at))
    corpus_pipeline.run(spark, SF)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before if not x.startswith("ledger")) == sorted(n for n, _ in corpus_pipeline.STAGES)


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_run_ends_with_packed_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_near_dedup", "secret_scan", "best_fit_packing"]
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert secrets.RULE_VERSION and corpus_pipeline.ORACLE_SQL is None
