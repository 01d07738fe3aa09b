"""Tokens, packing and files against the tokenizers library and brute force."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe, packing, queries, tokens, wavelet
from skein.llm.tokens import vocabulary, word_ids

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(vocabulary())


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


letters = st.text(alphabet=st.one_of(st.sampled_from("abeinorst'sdl.,<|>endoftx 09\n\té́İſß漢"), st.characters(exclude_categories=("Cs", "Cn"))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(letters)
def test_words_and_ranks_equal_the_library(text):
    lib = word_ids(vocabulary()).lib
    want = as_bytes(lib.encode(text, add_special_tokens=False).ids)
    assert word_ids(vocabulary()).encode(text.encode()) == want
    own = bpe.rank_bpe(vocabulary())
    assert own.encode(text.encode()) == want
    assert own.decode(want).decode() == lib.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), letters), max_size=12), st.integers(1, 60))
def test_columns_of_texts_have_the_ids_of_each(texts, most):
    words, column = word_ids(vocabulary()), pa.array(["cut off", *texts], pa.string())[1:]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens.stretches, "__defaults__", (most,))
        assert list(words.encode_all(column)) == [words.encode(t.encode()) if t else b"" for t in texts]
        runs = list(tokens.stretches(column))
    assert sum(n for _, n in runs) == len(texts) and all(n > 0 for _, n in runs)


def test_letters_and_marks_are_taken_without_the_whole_library(lib, monkeypatch):
    marks = [m for m in map(chr, range(0x21, 0x7F)) if not m.isalnum() and m != "'"]
    plain = [f"{w}{m}{n}" for w in ("enbezuver", "Été", "A") for m in marks for n in ("", "*", "_|>")]
    words, asked = tokens.WordIds(vocabulary()), []
    monkeypatch.setattr(words, "library", lambda w: (asked.append(w), as_bytes(ids_of(lib, w)))[1])
    other = ["***", "it's", "a.b", "x1", "ǅ!", "a<|endoftext|>", "1", "don't%%%", "e\u0301###"]
    for text in (" ".join(plain), " ".join(other)):
        for got in (words.encode(text.encode()), *words.encode_all(pa.array([None, text])[1:])):
            assert got == as_bytes(ids_of(lib, text))
    assert sorted(set(asked)) == sorted(other)
    assert list(words.encode_all(pa.array([None, ""]))) == [b"", b""]


def test_other_vocabularies_go_through_the_library_or_are_refused():
    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for text in ("Hello World, this is Été.", "  a  b\n", "it's we'll"):
        assert word_ids(path).encode(text.encode()) == as_bytes(lib.encode(text, add_special_tokens=False).ids)
    assert not word_ids(path).by_word and word_ids(vocabulary()).by_word
    with pytest.raises(ValueError):
        bpe.RankBPE(path)


def test_long_word_merges_alike(lib):
    own = bpe.RankBPE(vocabulary())
    for text in ("ab" * 400, "theinanre" * 300, "a" * 1000, "erhonin" * 11):
        assert own.encode(text.encode()) == as_bytes(ids_of(lib, text))


def test_op10_equals_the_library_on_whole_table(spark, lib):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, SF).collect():
        ids = ids_of(lib, docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_round_trip(spark, odd_docs, no_docs, lib):
    rows = bpe.bpe_decode(bpe.bpe_encode(odd_docs), out="back").select("text", "ids", "back").collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for r in rows:
        assert r["ids"] == ids_of(lib, r["text"]) and r["back"] == lib.decode(r["ids"], skip_special_tokens=False)
    assert bpe.bpe_digests(no_docs).count() == 0


def check_packing(rows, texts, lib, size=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids, at = [*ids_of(lib, t), 1], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[at : at + size]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(part), zlib.crc32(as_bytes(part)))
            at += len(part)
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    return len(by_seq), -(-total // size)


def test_op3_places_all_pieces(spark, lib):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences, least = check_packing(queries.op3_best_fit_packing(spark, SF).collect(), texts, lib)
    assert sequences <= least + 1


def test_packing_of_odd_rows(spark, odd_docs, no_docs, lib):
    rows = packing.pack_documents(odd_docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["length"] for r in rows if r["doc_id"] == 0) == 1
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1))
def test_plan_uses_each_length_as_often_as_it_is(counts):
    runs, sequences = packing.plan(counts, 50)
    seen, seqs = Counter(), defaultdict(list)
    for k, r, n, s, at in runs.tolist():
        assert r == seen[k]
        seen[k] += n
        for i in range(n):
            seqs[s + i].append((at, k))
    assert seen == Counter(counts) and sorted(seqs) == list(range(sequences))
    for parts in seqs.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= 50
    total = sum(k * v for k, v in counts.items())
    assert sequences <= 2 * -(-total // 50)  # no two sequences are both half empty


def test_plan_finds_exact_triples():
    assert packing.plan({20: 5, 17: 5, 13: 5}, 50)[1] == 5
    assert packing.plan({40: 3, 10: 3}, 50)[1] == 3
    assert packing.plan({50: 4}, 50)[1] == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400))
def test_wavelet_answers_like_a_list(ids):
    a = np.array(ids, dtype="<u4")
    shard = wavelet.WaveletShard(wavelet.build(a, [7], np.array([len(a)])))
    assert shard.tokens().tolist() == ids and shard.doc_ids == [7]
    for i in {0, len(ids) // 2, len(ids) - 1}:
        t = ids[i]
        assert shard.access(i) == t and shard.rank(t, i) == ids[:i].count(t) and shard.count(t) == ids.count(t)
        assert shard.select(t, ids[:i].count(t)) == i
    assert shard.count(9999) == 0


def test_wavelet_over_blocks():
    a = np.random.default_rng(1).integers(0, 49408, 200_000).astype("<u4")
    shard = wavelet.WaveletShard(wavelet.build(a, [1, None], np.array([150_000, 200_000])))
    assert (shard.tokens() == a).all() and shard.doc_ids == [1, None]
    for i in (0, 65535, 65536, 131072, 199_999):
        assert shard.access(i) == a[i] and shard.rank(int(a[i]), i) == (a[:i] == a[i]).sum()
        assert shard.select(int(a[i]), int((a[:i] == a[i]).sum())) == i


def test_op6_reads_back_all_ids(spark, lib):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, at = {r["doc_id"]: r for r in queries.op6_token_files(spark, SF).collect()}, 0
    for i in sorted(texts):
        ids = [*ids_of(lib, texts[i]), 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(as_bytes(ids)))
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files_of_odd_rows(spark, odd_docs, no_docs):
    rows = wavelet.token_file_round_trip(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and next(r for r in rows if r["doc_id"] == 0)["n_tokens"] == 1
    assert wavelet.token_file_round_trip(no_docs).count() == 0


def best_fit_decreasing(lengths, size):
    rooms = []
    for k in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= k]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - k)
        else:
            rooms.append(size - k)
    return len(rooms)


def test_complements_close_what_best_fit_leaves_open():
    counts = {6: 4, 5: 4, 3: 4, 2: 12}
    assert packing.plan(counts, 10)[1] == 8 and best_fit_decreasing([k for k, n in counts.items() for _ in range(n)], 10) == 9
    # a triple: 10 = 5 + 2 + 2 + 1, where best fit takes 5 + 4 and leaves 1s over
    index = packing.Complements({5: 1, 4: 1, 2: 2, 1: 1}, 10)
    assert index.exact(5, [5]) == [4, 1] and index.triple(5, [5]) == [2, 2, 1]
    index.take([4], 1)
    assert index.exact(5, [5]) == [2, 2, 1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_index_finds_a_combination_if_there_is_one(counts):
    index = packing.Complements(counts, 30)
    have = [k for k, n in counts.items() for _ in range(n)]
    for gap in range(1, 31):
        there = any(sum(c) == gap for r in (1, 2, 3) for c in itertools.combinations(have, r))
        found = index.exact(gap, [])
        assert bool(found) == there and (not found or sum(found) == gap and index.fits(found))
    runs, n = packing.plan(counts, 30)
    assert sum(r[2] for r in runs.tolist()) == len(have) and n >= -(-sum(have) // 30)
