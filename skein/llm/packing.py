"""Best-fit packing by exact-complement hashing.

Lengths of pieces are at most `size`, so their histogram has at most `size` rows however many
documents there are; the plan is made on it. For the longest length left, the gap is looked up among
single lengths, then sums of pairs, then of triples, in an index by sum; a combination found is
consumed as often as its counts allow. Gaps without a combination are narrowed by the longest length
that fits and looked up again; what still doesn't close is filled best-fit. Pieces then find their
place by their rank among pieces of the same length, counted in salted parts so that one frequent
length is never one task.

Null text: empty, thus a piece of the end id alone. Very long texts: whole, in pieces of `size` ids.
Equal rows and pieces of equal length: interchangeable, ranked by id, piece and digest. Empty table:
no rows. Other columns of the documents are not looked at, so they cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import ship, written
from skein.llm.tokens import MOST_WORDS, vocabulary, word_ids

SIZE = 4096
#: Pieces of one length that one task ranks.
RANK_ROWS = 100_000
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class Complements:
    """Counts of lengths, and an index by sum of the singles, pairs and triples of them.

    The pairs of a sum are hashed under it when it is first asked for: the longer lengths of them, in
    falling order. A triple is a length and a pair of what is left. Counts only fall: what is used up
    at the front of a sum is passed once and for all, by a cursor, so all look-ups of a sum together
    cost what it has.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.size = size
        self.up = sum(1 << k for k in self.left)
        self.lengths = sorted(self.left, reverse=True)
        self.own = np.array(self.lengths, dtype=np.int32)
        self.there = np.zeros(size + 1, dtype=bool)
        self.there[self.own] = True
        self.sums: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.third = [0] * (size + 1)

    def longer(self, total: int) -> np.ndarray:
        """The longer lengths of the pairs that sum to total."""
        found = self.sums.get(total)
        if found is None:
            a = self.own[(self.own < total) & (2 * self.own >= total)]
            found = self.sums[total] = a[self.there[a] & self.there[total - a]].astype(np.int16 if self.size < 1 << 15 else np.int32)
            self.at[total] = 0
        return found

    def take(self, lengths: list[int], n: int) -> None:
        for k in lengths:
            self.left[k] -= n
            if not self.left[k]:
                del self.left[k]
                self.up ^= 1 << k
                self.there[k] = False

    def longest(self, most: int) -> int:
        """The longest length up to most, or 0."""
        return (self.up & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.up & ((1 << (most + 1)) - 2) else 0

    def fits(self, lengths: list[int]) -> bool:
        return all(self.left.get(k, 0) >= lengths.count(k) for k in lengths)

    def pair(self, gap: int, held: list[int]) -> list[int] | None:
        longer = self.longer(gap)
        i, end = self.at[gap], len(longer)
        while i < end and not self.fits([a := int(longer[i]), gap - a]):
            i += 1
        self.at[gap] = i
        for j in range(i, end):  # past the first only what `held` keeps from being taken now
            found = [a := int(longer[j]), gap - a]
            if self.fits([*held, *found]):
                return found
        return None

    def triple(self, gap: int, held: list[int]) -> list[int] | None:
        while self.third[gap] < len(self.lengths):  # used up for good, or with no pair left for the rest
            a = self.lengths[self.third[gap]]
            if a in self.left and a < gap - 1 and self.pair(gap - a, []):
                break
            self.third[gap] += 1
        for k in range(self.third[gap], len(self.lengths)):
            a = self.lengths[k]
            if 3 * a < gap:
                break
            if a < gap - 1 and self.fits([*held, a]) and (found := self.pair(gap - a, [*held, a])):
                return [a, *found]
        return None

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that sum to gap and are there beside those held."""
        if gap in self.left and self.fits([*held, gap]):
            return [gap]
        return self.pair(gap, held) or self.triple(gap, held)

    def fill(self, first: int) -> list[int]:
        """The lengths that share a sequence with `first`."""
        held, gap = [first], self.size - first
        while gap > 0:
            if found := self.exact(gap, held):
                return held + found
            a = self.longest(gap)
            while a and not self.fits([*held, a]):
                a = self.longest(a - 1)
            if not a:
                break
            held.append(a)
            gap -= a
        return held


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, rows, first sequence, offset) for all pieces, by length and rank; the number of sequences."""
    have, used, runs, sequences = Complements(counts, size), dict.fromkeys(counts, 0), [], 0
    while have.left:
        lengths = have.fill(have.longest(size))
        n = min(have.left[k] // lengths.count(k) for k in lengths)
        at = 0
        for k in lengths:
            runs.append((k, used[k], n, sequences, at))
            used[k] += n
            at += k
        have.take(lengths, n)
        sequences += n
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), sequences


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = SIZE, path: str | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per piece of a document: its ids and the end id, cut after each `size` of them. A worker remembers most_words words."""
    ship(docs.sparkSession)
    path = path or vocabulary()

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        words, end = word_ids(path, most_words), int(end_id).to_bytes(4, "little")
        ends, rows = [0], []
        for x in texts.cast(pa.large_binary()).to_pylist():
            ids = words.encode(x) + end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            ends.append(len(rows))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        inner = pa.StructArray.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(cut(F.col(text))).alias("p")).select("doc_id", "p.*")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    ship(pieces.sparkSession)
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs, _ = plan(counts, size)
    salts = max(16, -(-max(counts.values(), default=1) // RANK_ROWS))
    key = runs[:, 0] << 44 | runs[:, 1]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, n << 44 | r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(runs[at, 3] + r - runs[at, 1]), pa.array(runs[at, 4])], names=["sequence_id", "offset"])

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_salt", "_base")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(within)).join(base, ["length", "_salt"])
    placed = ranked.withColumn("_p", place(F.col("length"), F.col("_base") + F.col("_r") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = SIZE, path: str | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents' pieces, packed."""
    return pack(pieces_of(docs, doc_id, text, end_id, size, path, most_words), size)
