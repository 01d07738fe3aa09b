"""Repetition coverage against a direct count."""

import re
from collections import Counter

from skein.llm import quality, queries

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n, out = len(words), {}
    for k in {k for k, _ in quality.LIMITS} | {5}:
        grams = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        marks = {j for i in range(n - k + 1) if grams[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
        out[k] = marks
    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            if line in seen:
                dup += 1
                chars += sum(map(len, re.findall("[^\x20\x09-\x0d]+", line)))
            seen.add(line)
    total, symbols, repeat = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(out[5])
    failed = n < 10 or 100 * repeat > 20 * n
    share = [sum(len(words[j]) for j in out[k]) / total if total else 0.0 for k, _ in quality.LIMITS]
    over = any(s > most for s, (_, most) in zip(share, quality.LIMITS)) or (total and chars / total > quality.LINE_LIMIT) or symbols > quality.SYMBOL_LIMIT * total
    return n, total, symbols, dup, repeat, failed, not failed and not over


def test_op7_equals_a_direct_count(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r["doc_id"]]), r["doc_id"]


def test_odd_rows(odd_docs, no_docs):
    rows = quality.quality_signals(odd_docs, out="q").select("text", "quality", "_measured", "q").collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for r in rows:
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"], q["kept"]) == brute(r["text"])
    assert quality.quality_filter(no_docs).count() == 0 and quality.quality_filter(odd_docs).columns == odd_docs.columns


def test_repeated_passage_is_rejected_and_prose_kept(spark):
    prose = " ".join(f"w{i * 7919 % 1009} of" for i in range(200))
    docs = spark.createDataFrame([(1, prose), (2, (prose[:200] + " ") * 20)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality.quality_filter(docs).collect()] == [1]
