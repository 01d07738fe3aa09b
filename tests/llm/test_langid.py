"""Held-out accuracy and odd rows."""

import re

import numpy as np

from skein.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_op5_on_held_out_rows(spark):
    import zlib

    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    right = total = 0
    for r in rows:
        t = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"] and t["lang"] and re.search(r"[^\W\d_]", t["text"] or ""):
            total += 1
            right += r["lang_pred"] == t["lang"]
    assert total > 100 and right / total > 0.97
    assert sum(r["accepted"] for r in rows) > 0.97 * len(rows)


def test_odd_rows(odd_docs, no_docs):
    model = langid.fit_language_model(odd_docs)
    rows = {r["text"]: r["language"] for r in langid.identify(odd_docs, model).collect()}
    for t in (None, "", " ", "\n\t "):
        assert rows[t]["lang_pred"] == "und" and not rows[t]["accepted"]
    assert rows["a"]["lang_pred"] == "en"
    assert langid.identify(no_docs, langid.fit_language_model(no_docs)).count() == 0
    assert langid.identify(odd_docs, langid.fit_language_model(no_docs)).filter("language.lang_pred <> 'und'").count() == 0
    assert langid.language_filter(odd_docs).columns == odd_docs.columns


def test_prediction_equals_a_plain_forward_pass():
    """Without folding and without a memory of words: the mean of all subwords' rows, the softmax, the temperature."""
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(40)) for letters in ("abcde", "defgh", "ghijk") for _ in range(40)]
    model = langid.train(texts, [x for x in ("a", "b", "c") for _ in range(40)])
    for text in [*texts[::13], "Abc, DEF! 12", "x" * 300 + " abc", "é漢字 cab", ".", "a" * 64]:
        rows = langid.Grams(len(model.table))
        ids = [i for w in langid.normal(text.encode()) for i in langid.subwords(w, rows).tolist()]
        want = model.predict(text.encode())
        if not any(c.isalpha() for c in text):
            assert want == ("und", 0.0, False)
            continue
        z = (model.table[ids].mean(0) @ model.out + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert want[0] == model.labels[p.argmax()] and abs(want[1] - p.max()) < 1e-4 and want[2] == (want[1] >= model.threshold)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_TEXT", 4000)
    sent = []
    monkeypatch.setattr(langid, "train", lambda texts, langs, **options: sent.append(texts))
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('ab ', 300 + CAST(id AS INT)) AS text", "'en' AS lang")
    langid.fit_language_model(docs, sample_bytes=100_000)
    assert 20_000 < sum(map(len, sent[0])) < 300_000 and max(map(len, sent[0])) <= 4000


def test_very_long_text(spark):
    model = langid.train(["abba cab baca bacca " * 30, "xyzzy zyx yxxz zyzy " * 30] * 20, ["one", "two"] * 20)
    docs = spark.createDataFrame([(1, "abba cab " * 20_000 + "zyzy xyzzy " * 100_000)], "doc_id long, text string")
    assert langid.identify(docs, model).first()["language"]["lang_pred"] == "two"


def test_whole_of_a_long_word_is_read():
    rows = langid.Grams(1 << 40)
    word = "".join(chr(97 + i * i % 26) for i in range(200)) + "ßzq"
    have = set(langid.subwords(word.encode(), rows).tolist())
    marked = f"<{word}>"
    assert have == {rows[g] for k in langid.LENGTHS for i in range(len(marked) - k + 1) if (g := marked[i : i + k]) not in ("<", ">")} | {rows[marked]}
    one, two = "abba cab baca bacca " * 30, "xyzzy zyx yxxz zyzy " * 30
    model = langid.train([one, two] * 20, ["one", "two"] * 20)
    assert model.predict((one[:80] + two * 5).replace(" ", "\u00a0").encode())[0] == "two"
    assert not any(len(w) > langid.LONG for w in model.words)
