"""Token ids in shard files, each a wavelet matrix: bit-planes with rank directories.

A shard holds whole documents in ascending id order. Each bit of an id, the highest first, is a
plane; below a plane the ids whose bit is 0 stand before those whose bit is 1, in stable order.
From one file come access(i), rank (how often an id occurs before i), count and select (where its
j-th occurrence is), and the whole array. Planes are stored in zstd blocks with a directory of
counts, so a point query inflates one block a plane.

Null text: only the end id. Null id: sorted first. Equal ids: ordered by text. Empty table: no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import new_path, ship, written
from skein.llm.tokens import vocabulary, word_ids

MAGIC = b"SKWM0001"
#: Bits of a plane in one compressed block; a shard is closed at so many tokens.
BLOCK_BITS, SHARD_TOKENS = 1 << 16, 1 << 20


def build(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The bytes of a shard. ends: for each document, the count of ids up to its end."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    zeros, planes = [], []
    for bit in range(bits - 1, -1, -1):
        one = (a & (1 << bit)).astype(bool)
        packed = np.packbits(one, bitorder="little")
        a = np.concatenate((a.compress(~one), a.compress(one)))
        z = n - int(np.count_nonzero(one))
        zeros.append(z)
        step = BLOCK_BITS // 8
        blocks = [press.compress(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        ones = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), step)) if len(packed) else np.empty(0, np.int64)
        planes.append((np.array([len(b) for b in blocks], dtype="<u4"), np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u4"), b"".join(blocks)))
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    docs = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + known.tobytes() + np.asarray(ends, dtype="<u8").tobytes()
    head = MAGIC + struct.pack("<QQII", n, len(doc_ids), bits, BLOCK_BITS)
    return b"".join([head, struct.pack("<I", len(d := press.compress(docs))), d, np.array(zeros, dtype="<u8").tobytes(), *(x for sizes, ranks, body in planes for x in (struct.pack("<I", len(sizes)), sizes.tobytes(), ranks.tobytes(), body))])


class WaveletShard:
    """Reads the bytes of a shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.data = data
        self.n, self.n_docs, self.bits, self.block = struct.unpack_from("<QQII", data, 8)
        size = struct.unpack_from("<I", data, 32)[0]
        self.inflate = zstandard.ZstdDecompressor().decompress
        docs, at = self.inflate(data[36 : 36 + size]), 36 + size
        ids, known = np.frombuffer(docs, "<i8", self.n_docs), np.frombuffer(docs, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.ends = np.frombuffer(docs, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.planes = []
        for _ in range(self.bits):
            k = struct.unpack_from("<I", data, at)[0]
            sizes, ranks = np.frombuffer(data, "<u4", k, at + 4), np.frombuffer(data, "<u4", k, at + 4 + 4 * k)
            at += 4 + 8 * k
            where = at + np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
            self.planes.append((where, ranks))
            at = int(where[-1])
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        found = self.kept.get((level, k))
        if found is None:
            where = self.planes[level][0]
            found = np.frombuffer(self.inflate(self.data[where[k] : where[k + 1]]), np.uint8)
            if len(self.kept) > 64:
                self.kept.clear()
            self.kept[level, k] = found
        return found

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before i."""
        k, rest = divmod(i, self.block)
        where, ranks = self.planes[level]
        if k == len(ranks):
            k, rest = k - 1, rest + self.block
        if k < 0:
            return 0
        block = self._block(level, k)
        whole = int(np.bitwise_count(block[: rest // 8]).sum())
        part = int(block[rest // 8] & ((1 << (rest % 8)) - 1)).bit_count() if rest % 8 else 0
        return int(ranks[k]) + whole + part

    def _bit(self, level: int, i: int) -> int:
        k, rest = divmod(i, self.block)
        return int(self._block(level, k)[rest // 8] >> (rest % 8)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if one else i - ones
            out = out << 1 | one
        return out

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        """The range, in the order below the last plane, of a token's occurrences before i."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often token occurs before place i."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._walk(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of the j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        i = self._walk(token, self.n)[0] + j
        for level in range(self.bits - 1, -1, -1):
            z, one = int(self.zeros[level]), token >> (self.bits - 1 - level) & 1
            want = i - z if one else i  # the want-th one (or zero) of this plane
            lo, hi = 0, self.n - 1
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._rank1(level, mid + 1)
                lo, hi = (lo, mid) if (ones if one else mid + 1 - ones) > want else (mid + 1, hi)
            i = lo
        return i

    def tokens(self) -> np.ndarray:
        """All ids, in order."""
        a = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            where = self.planes[level][0]
            packed = b"".join(self.inflate(self.data[s:e]) for s, e in zip(where[:-1], where[1:], strict=True))
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            z, bit = int(self.zeros[level]), self.bits - 1 - level
            above = np.empty_like(a)
            above[np.flatnonzero(~one)] = a[:z]  # places, not masks: bits without a pattern make masks slow
            above[np.flatnonzero(one)] = a[z:] | a.dtype.type(1 << bit)
            a = above
        return a


def _put(where: fs.FileSystem, path: str, data: bytes) -> None:
    """Write under another name and rename, so a lost task leaves no half file."""
    with where.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    where.move(part, path)


def write_token_shards(docs: DataFrame, to: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts and write them as shards under `to`; one row per shard: part, seq, n_docs, n_tokens.

    Shards of parts 0, 1, … and their seq ascend in document id.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end, part, seq = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        where, root = fs.FileSystem.from_uri(to)
        where.create_dir(root, recursive=True)
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal held, doc_ids, sizes, total, seq
            data = build(np.frombuffer(b"".join(held), dtype="<u4"), doc_ids, np.cumsum(sizes))
            _put(where, f"{root}/part-{part:06d}-{seq:06d}.wm", data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(doc_ids), "n_tokens": total, "n_bytes": len(data)}], schema=SHARD_SCHEMA)
            held, doc_ids, sizes, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                ids += end
                held.append(ids)
                doc_ids.append(i)
                sizes.append(len(ids) // 4)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(write, "part int, seq int, n_docs long, n_tokens long, n_bytes long")


SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
DOC_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_shards(shards: DataFrame, at: str) -> DataFrame:
    """One row per document of the shard files under `at`: doc_id, start (of all ids), n_tokens, ids_crc32."""
    spark = shards.sparkSession
    # one row per written part: as many as the range partitions, however many documents there are
    parts = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = [], 0
    for part, n in parts:
        bases.append((part, total))
        total += n
    seqs = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(seqs), F.lit(0))).join(spark.createDataFrame(bases, "part int, base long"), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = WaveletShard(data.as_py())
                part, seq = (int(x) for x in os.path.basename(name)[5:-3].split("-"))
                ids = memoryview(shard.tokens().astype("<u4").tobytes())
                starts = np.concatenate(([0], shard.ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                k = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.ends - starts), pa.array(crcs, pa.int64())], schema=DOC_SCHEMA)

    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(at).select("path", "content")
    found = files.mapInArrow(read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write all documents as shards in the shared folder and read the files back."""
    to = new_path(docs.sparkSession, "tokens")
    shards = written(write_token_shards(docs, to, doc_id, text, end_id, path), "shards")
    return read_token_shards(shards, to)
