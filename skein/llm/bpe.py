"""BPE encoding and decoding over a contiguous rank array.

A short word is held as an array of part boundaries and an array of the ranks of adjacent parts.
The smallest rank is looked up by a scan, its boundary deleted, and the ranks left and right of it
are looked up anew, until no adjacent parts merge. The vocabulary file gives the merges, the
normalisation (composed form, white space to one space, lower case), the split pattern and the
special strings; this module carries them out itself, without the tokenizers library.

A null or empty text has no ids and decodes to an empty string. Very long texts are read whole, in
time that grows with their length. Of equal ranks the leftmost merges first. Repeated rows have equal
results. Empty table: no rows. Extra columns stay; the result's column is named by the caller.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import claim, raw, ship
from skein.llm.tokens import by_word, byte_letters, vocabulary

NO_RANK = 1 << 30
#: Above this many parts the minimum comes from a heap, so that one very long word stays cheap.
LONG_WORD = 64


class RankBPE:
    """The encoder and decoder of one vocabulary file, with a bounded memory of words."""

    def __init__(self, path: str, most: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are read")
        added = spec["added_tokens"]
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in added) or not by_word(spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], [x["content"] for x in added]):
            raise ValueError("the file has other rules of normalisation or splitting")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: Pairs of part ids to (rank, id of what they make).
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s.encode()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.first[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        parts = [p for p in parts if p is not None]
        ranks, pair = self.ranks, (NO_RANK, -1)
        adjacent = [ranks.get(ab, pair) for ab in zip(parts, parts[1:])]
        if len(adjacent) > LONG_WORD:
            return self.merge_long(parts, adjacent)
        while adjacent:
            low = min(adjacent)
            if low[0] == NO_RANK:
                break
            at = adjacent.index(low)
            parts[at] = low[1]
            del parts[at + 1], adjacent[at]
            if at:
                adjacent[at - 1] = ranks.get((parts[at - 1], parts[at]), pair)
            if at < len(adjacent):
                adjacent[at] = ranks.get((parts[at], parts[at + 1]), pair)
        return parts

    def merge_long(self, parts: list[int], adjacent: list[tuple[int, int]]) -> list[int]:
        """The same for a word of many parts: the boundaries are a linked array, the adjacent ranks a heap.

        The heap gives the lowest rank, the leftmost place of equals. An entry whose rank at its
        place is no longer the current one is left out.
        """
        import heapq

        ranks, pair, n = self.ranks, (NO_RANK, -1), len(parts)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, m) for i, (r, m) in enumerate(adjacent) if r != NO_RANK]
        now = [r for r, _ in adjacent] + [NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, made = heapq.heappop(heap)
            if not alive[i] or now[i] != r:
                continue
            j = right[i]
            parts[i], alive[j], right[i] = made, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0:
                    b = right[a]
                    now[a], m = ranks.get((parts[a], parts[b]), pair) if b < n else pair
                    if now[a] != NO_RANK:
                        heapq.heappush(heap, (now[a], a, m))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            found = np.array(self.merge(text.encode()), dtype="<u4").tobytes()
            self.pieces[text] = found
        return found

    def normal(self, text: str) -> str:
        """Composed form, then lower case letter by letter: no letter's form depends on those beside it."""
        if text.isascii():
            return text.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", text))

    def word(self, word: bytes) -> bytes:
        """Ids of a run without ASCII white space; the pattern never matches over white space."""
        text, out = word.decode(), []
        for part in self.cut.split(text) if self.cut and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += map(self.piece, self.pattern.findall(self.normal(part)))
        return b"".join(out)

    def encode(self, text: bytes | None) -> bytes:
        """A whole text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        if len(self.words) >= self.most:
            self.words.clear()
        known = self.words
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: their strings with a space between, as a vocabulary without decoder has it."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(2)
def _rank_bpe(path: str) -> RankBPE:
    return RankBPE(path)


def rank_bpe(path: str) -> RankBPE:
    found = _rank_bpe(path)
    claim("bpe", found.words, found.pieces)
    return found


def bpe_digests(docs: DataFrame, text: str = "text", out: str = "bpe", path: str | None = None) -> DataFrame:
    """docs with a struct column `out`: n_tokens, and the digests of the ids and of the text decoded from them."""
    ship(docs.sparkSession)
    path = path or vocabulary()

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe, rows = rank_bpe(path), []
        for x in raw(texts):
            ids = bpe.encode(x)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, digests(F.col(text)))


def bpe_encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column of ids (array of int)."""
    ship(docs.sparkSession)
    path = path or vocabulary()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = rank_bpe(path)
        return pa.array([np.frombuffer(bpe.encode(x), dtype="<u4").astype(np.int32) for x in raw(texts)], type=pa.list_(pa.int32()))

    return docs.withColumn(out, encode(F.col(text)))


def bpe_decode(rows: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """rows with a column of the texts that the ids decode to; null ids give an empty text."""
    ship(rows.sparkSession)
    path = path or vocabulary()

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        bpe = rank_bpe(path)
        return pa.array([bpe.decode(np.array(x or [], dtype="<u4").tobytes()).decode() for x in column.to_pylist()], type=pa.string())

    return rows.withColumn(out, decode(F.col(ids)))


